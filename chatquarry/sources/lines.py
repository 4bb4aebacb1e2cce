"""Lines of text files with their true numbers and their order, however files are cut into splits.

A scan tells of each line in which file and at which byte its split begins. Lines are counted by split, and a split's
lines begin after those of the splits before it, so no task holds more than a split, whatever a file's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FILE, _START, _ROW = "__file", "__start", "__row"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """text and, for place(), the line's file and split; blank lines are there, too."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_START))


def place(lines: DataFrame, in_file: str | None = None, overall: str | None = None) -> DataFrame:
    """lines, a scan() with any columns added or rows left out, numbered by those before them: in_file, overall (from 0).

    Files follow each other by name. Rows are numbered within a scan's partition, where a split's rows follow each
    other; the splits' counts, one row each, are summed over the splits before. The scan runs once to count and once
    to number, so the files must not change meanwhile. `lines` must not have been shuffled.
    """
    lines = lines.withColumn(_ROW, F.monotonically_increasing_id())
    splits = lines.groupBy(_FILE, _START).agg(F.count(F.lit(1)).alias("__n"), F.min(_ROW).alias("__low"))
    before = lambda by: F.coalesce(F.sum("__n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("__in_file", before(W.partitionBy(_FILE).orderBy(_START)))
    if overall:
        files = splits.groupBy(_FILE).agg(F.sum("__n").alias("__n"))
        splits = splits.join(files.select(_FILE, before(W.partitionBy(F.lit(1)).orderBy(_FILE)).alias("__files")), _FILE)  # a row a file
    out = lines.join(splits.drop("__n"), [_FILE, _START])
    at = F.col(_ROW) - F.col("__low") + F.col("__in_file")
    if in_file:
        out = out.withColumn(in_file, at)
    if overall:
        out = out.withColumn(overall, at + F.col("__files"))
    return out.drop(_START, _ROW, "__low", "__in_file", "__files")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of all lines: numbers from 1 within each file, blank lines counted."""
    return place(scan(spark, path), in_file="line").select(F.col(_FILE).alias("file"), (F.col("line") + 1).alias("line"), "text")


def first(lines: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of lines, a scan() with rows left out, in the order in which the files would be read."""
    return place(lines, overall="__at").where(F.col("__at") < most).drop("__at", _FILE)


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two scans, each with rows left out and columns added, side by side in the order of their files.

    Columns of both (other than text) must differ in name; text, where it is there, is the left one's. Different
    numbers of rows are an error, found when the result is read.
    """
    a, b = place(left, overall="__at").drop(_FILE), place(right, overall="__at").drop(_FILE, "text")
    both = a.withColumn("__left", F.lit(True)).join(b.withColumn("__right", F.lit(True)), "__at", "full_outer")
    lone = F.concat(F.lit("only the "), F.when(F.col("__left").isNull(), F.lit("second")).otherwise(F.lit("first")), F.lit(" side has a row "), F.col("__at").cast("string"))
    checked = F.when(F.col("__left").isNull() | F.col("__right").isNull(), F.raise_error(lone).cast("boolean")).otherwise(F.lit(True))
    return both.where(checked).drop("__left", "__right").withColumnRenamed("__at", "position")


def where(file: Column, line: Column) -> Column:
    """file:line, as errors name it."""
    return F.concat(file, F.lit(":"), line.cast("string"))
