"""Queries of large text files: true line numbers, ordered prefixes, two files side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lines, readers
from .registry import query
from .views import scratch, table

#: Ids whose lines make a file, so that files become more with the data, and bytes of a split, so that each has several.
FILE_IDS, SPLIT = 500, "128k"


def written(spark: SparkSession, rows: DataFrame, line: Column, ids: int = FILE_IDS) -> str:
    """A folder of text files, a file for each range of so many doc_ids, its lines in their order."""
    path = scratch(spark, "files")
    part = F.format_string("%08d", F.floor(F.col("doc_id") / ids))
    rows.select(part.alias("part"), "doc_id", line.alias("value")).repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return path


def split_small(spark: SparkSession) -> SparkSession:
    """A session of the same application that cuts files into small splits."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.files.maxPartitionBytes", SPLIT)
    own.conf.set("spark.sql.files.openCostInBytes", "16k")
    return own


def _prompt(cut: Column, lone: Column | None = None) -> Column:
    """A JSON line of a document; where `cut` holds without its end, where `lone` holds without an answer."""
    answer = F.col("doc_id").cast("string")
    line = F.to_json(F.struct(F.col("text").alias("prompt"), (F.when(~lone, answer) if lone is not None else answer).alias("answer")))
    return F.when(cut, F.substr(line, F.lit(1), F.length(line) - 2)).otherwise(line)


_FILES = f"row_number() over (partition by doc_id // {FILE_IDS} order by doc_id)"


@query(f"select doc_id // {FILE_IDS} as part, line, chars from (select doc_id, {_FILES} as line, length(text) as chars from documents where text is not null) where doc_id % 7 = 3")
def malformed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """File and line of what a strict read refuses: every seventh line is cut short, files have several splits."""
    docs = table(spark, folder, "documents").where("text is not null")
    path = written(spark, docs, F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit('{"id": '), F.length("text").cast("string"))).otherwise(_prompt(F.lit(False))))
    bad = readers.bad_lines(split_small(spark), path, "validation")
    return bad.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "line", F.regexp_extract("text", "([0-9]+)$", 1).cast("long").alias("chars"))


@query("""with v as (select doc_id, md5(text) as prompt_md5, row_number() over (order by doc_id) as k from documents where text <> '' and doc_id % 7 <> 3 and doc_id % 5 <> 0)
select doc_id::varchar as answer, prompt_md5 from v where k <= (select count(*) from documents) // 3""")
def first_valid_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first third as many valid lines as there are documents; some lines are cut short, some have no answer."""
    docs = table(spark, folder, "documents")
    path = written(spark, docs, _prompt(F.col("doc_id") % 7 == 3, F.col("doc_id") % 5 == 0))
    rows = readers.lenient_json(split_small(spark), path, "validation", (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("prompt", F.lit("")) != ""), most=docs.count() // 3)
    return rows.select("answer", F.md5("prompt").alias("prompt_md5"))


@query("select row_number() over (order by doc_id) - 1 as position, md5(text) as prompt_md5, doc_id, lang from documents where text is not null")
def zipped_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts and what belongs to them, written apart without ids in files of different lengths, side by side again."""
    docs = table(spark, folder, "documents").where("text is not null")
    own = split_small(spark)
    left = lines.scan(own, written(spark, docs, F.to_json(F.struct(F.col("text").alias("prompt")))))
    right = lines.scan(own, written(spark, docs, F.to_json(F.struct("doc_id", "lang")), FILE_IDS // 2 + 7))
    facts = F.from_json("text", "doc_id long, lang string")
    both = lines.zipped(left.withColumn("prompt", F.get_json_object("text", "$.prompt")).drop("text"), right.withColumn("facts", facts))
    return both.select("position", F.md5("prompt").alias("prompt_md5"), "facts.doc_id", "facts.lang")
