"""Readers: strict and lenient JSON lines, Parquet, several configurations, ordered fallback, schema contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import blank
from . import lines
from .sinks import exists

MESSAGES = "array<struct<role:string,content:string>>"
SCHEMAS = {
    "raw": "query string, response string",
    "generated": "problem string, generated_solution string, expected_answer string, problem_source string",
    "leveled": "problem string, solution string, level string, type string, answer string, subject string",
    "olympiad": "problem string, solution string, source string",
    "validation": "prompt string, answer string",
    "chat": f"messages {MESSAGES}",
    "generations": "prompt string, answer string, reference string, completions array<string>",
    "rewarded": "prompt string, answer string, solve_rate double",
}


def schema(kind: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[kind])


def _parsed(text: Column, fields: T.StructType) -> Column:
    """A JSON line by a schema, with the line itself in _corrupt_record where it is malformed."""
    return F.from_json(text, T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt_record"})


def strict_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines by a fixed schema; a malformed line ends the read with file:line and its text, blank lines don't count."""
    rows = lines.numbered(spark, path).where(~blank(F.col("text"))).withColumn("__r", _parsed(F.col("text"), schema(kind)))
    told = F.concat(F.lit("malformed line in "), lines.where(F.col("file"), F.col("line")), F.lit(": "), F.left(F.col("text"), F.lit(200)))
    return rows.where(F.when(F.col("__r._corrupt_record").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).select("__r.*").drop("_corrupt_record")


def bad_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, line, text) of the malformed lines: lines are numbered from 1 over each file, blank ones counted."""
    rows = lines.numbered(spark, path).where(~blank(F.col("text")))
    return rows.where(_parsed(F.col("text"), schema(kind))["_corrupt_record"].isNotNull())


def lenient_json(spark: SparkSession, path: str, kind: str, valid: Column | None = None, most: int | None = None) -> DataFrame:
    """JSON lines without the malformed and the invalid; with `most`, the first so many valid rows, as a sequential read
    of the files by name gives them."""
    rows = lines.scan(spark, path).where(~blank(F.col("text"))).withColumn("__r", _parsed(F.col("text"), schema(kind))).where("__r._corrupt_record is null")
    names = schema(kind).fieldNames()
    rows = rows.select(*[F.col(f"__r.{n}").alias(n) for n in names], *[c for c in rows.columns if c.startswith("__") and c != "__r"])
    rows = rows.where(valid) if valid is not None else rows
    return (rows if most is None else lines.first(rows, most)).select(*names)


def strict_prompts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """prompt, answer; a malformed line, or a missing or empty one of both, is an error that names file:line.

    With `most`, only the first so many lines that aren't blank are judged; errors then name the file and such a
    line's number among these, from 0.
    """
    if most is None:
        rows = lines.numbered(spark, path).where(~blank(F.col("text"))).withColumn("__where", lines.where(F.col("file"), F.col("line")))
    else:
        rows = lines.place(lines.scan(spark, path).where(~blank(F.col("text"))), overall="__at").where(F.col("__at") < most)
        rows = rows.withColumn("__where", F.concat("__file", F.lit(", row "), F.col("__at").cast("string")))
    rows = rows.withColumn("__r", _parsed(F.col("text"), schema("validation")))
    empty = lambda c: F.coalesce(F.col(f"__r.{c}"), F.lit("")) == ""
    wrong = F.when(F.col("__r._corrupt_record").isNotNull(), F.lit("a malformed line")).when(empty("prompt"), F.lit("no prompt")).when(empty("answer"), F.lit("no answer"))
    told = F.concat(wrong, F.lit(" in "), F.col("__where"), F.lit(": "), F.left(F.col("text"), F.lit(200)))
    return rows.where(F.when(wrong.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).select("__r.prompt", "__r.answer")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def configurations(spark: SparkSession, paths: dict[str, str], column: str = "config") -> DataFrame:
    """A union over named Parquet inputs with the name beside each row; an unreadable one is named in the error."""
    out: DataFrame | None = None
    for name, path in paths.items():
        try:
            one = spark.read.parquet(path).withColumn(column, F.lit(name))
        except AnalysisException as e:
            raise ValueError(f"configuration {name} can't be read from {path}") from e
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no configurations")
    return out


def first_readable(spark: SparkSession, paths: Sequence[str], groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """The first path that can be read; its columns must hold one of each group."""
    for path in (p for p in paths if exists(spark, p)):
        try:
            out = spark.read.parquet(path)
        except AnalysisException:
            continue
        require_columns(out, groups)
        return out
    raise ValueError(f"none of {list(paths)} can be read")


def require_columns(df: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """An error unless the columns hold at least one name of every group."""
    for names in groups:
        if not set(names) & set(df.columns):
            raise ValueError(f"none of the columns {list(names)} is there; there are {df.columns}")
    return df


def validation_problems(df: DataFrame, order_by: str) -> DataFrame:
    """problem_id (validation_0, ...), problem, gold_answer."""
    from ..operators.curate import dense_id

    return dense_id(df, order_by, "i").select(F.concat(F.lit("validation_"), F.col("i").cast("string")).alias("problem_id"), F.col("prompt").alias("problem"), F.col("answer").alias("gold_answer"))


def chat_problems(df: DataFrame, order_by: str) -> DataFrame:
    """problem_id (indist_0, ... over the rows kept), problem, gold_answer of conversations with a boxed answer."""
    from ..functions.chat import prompt_and_gold
    from ..operators.curate import dense_id

    kept = df.withColumn("__p", prompt_and_gold(F.col("messages"))).where("__p is not null")
    return dense_id(kept, order_by, "i").select(F.concat(F.lit("indist_"), F.col("i").cast("string")).alias("problem_id"), F.col("__p.prompt").alias("problem"), F.col("__p.gold").alias("gold_answer"))
