"""Writers: JSON lines in one file or many, a train and eval pair, single documents, completion markers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, single: bool = False) -> int:
    """Writes JSON lines (text and nulls as they are) and returns the number of rows, counted on the way.

    single puts all rows in one part, for small outputs alone.
    """
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    (out.coalesce(1) if single else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return int(seen.get["n"])


def train_eval(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder for each split, from one pass."""
    df.write.mode("overwrite").partitionBy(column).option("ignoreNullFields", "false").json(path)


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def document(spark: SparkSession, row: dict, path: str) -> None:
    """One JSON document, indented, in any file system that Spark writes; for summaries of a row."""
    text(spark, json.dumps(row, indent=2, ensure_ascii=False), path)


def text(spark: SparkSession, content: str, path: str) -> None:
    """A report's text, in any file system that Spark writes."""
    where, system = _open(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray((content if content.endswith("\n") else content + "\n").encode()))
    finally:
        out.close()


def renamed(spark: SparkSession, content: str, path: str) -> bool:
    """Puts a text at a path that nobody sees before it is whole: written beside it, then renamed.

    False, and nothing changed, where the path is there already.
    """
    beside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    text(spark, content, beside)
    where, system = _open(spark, beside)
    if not exists(spark, path) and system.rename(where, spark._jvm.org.apache.hadoop.fs.Path(path)):
        return True
    system.delete(where, False)
    return False


def document_at(spark: SparkSession, path: str) -> dict | None:
    """A document that document() wrote; None where there is none, or no JSON object."""
    if not exists(spark, path):
        return None
    lines = spark.read.text(path, wholetext=True).first()
    try:
        found = json.loads(lines[0]) if lines else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def mark(spark: SparkSession, folder: str) -> None:
    """The marker of a folder whose documents are all written."""
    text(spark, "", f"{folder}/completed.marker")


def marked(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/completed.marker")


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _open(spark, path)
    return bool(system.exists(where))


def complete(df: DataFrame, path: str) -> bool:
    """The output has its success marker, so a rerun can skip it."""
    return exists(df.sparkSession, f"{path}/_SUCCESS")


def once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Writes JSON lines unless they are complete already; whether it wrote."""
    if not force and complete(df, path):
        return False
    json_lines(df, path)
    return True
