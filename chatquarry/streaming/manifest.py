"""Chunks of a run that are either wholly there or not at all: data first, then a manifest by an atomic rename.

A reader lists the manifests and reads only the data that they name, so that data without a manifest, of a run that
was killed or still goes on, isn't seen. On stores whose rename isn't atomic a manifest may be seen late, not early.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks


def _manifest(out: str, chunk: int) -> str:
    return f"{out}/manifest/{chunk:012d}.json"


def commit(rows: DataFrame, out: str, chunk: int, between: Callable[[], None] = lambda: None) -> bool:
    """Writes a chunk's rows and then its manifest; False, and nothing, where the chunk is committed already.

    The manifest has the data's path, its rows and a digest of them, taken while they are written. `between` runs
    when the data is there and the manifest isn't.
    """
    spark, final = rows.sparkSession, _manifest(out, chunk)
    if sinks.exists(spark, final):
        return False
    data, seen = f"{out}/data/{chunk:012d}-{uuid.uuid4().hex}", Observation()
    hashed = F.xxhash64(*rows.columns) if rows.columns else F.lit(0)
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(hashed), F.lit(0)).alias("digest")).write.parquet(data)
    between()
    about = {"chunk": chunk, "path": data, "rows": int(seen.get["rows"]), "digest": int(seen.get["digest"])}
    return sinks.renamed(spark, json.dumps(about), final)


def chunks(spark: SparkSession, out: str) -> list[dict]:
    """The manifests of the committed chunks, in order: chunk, path, rows, digest. A row a chunk."""
    folder = f"{out}/manifest"
    if not sinks.exists(spark, folder):
        return []
    found = [json.loads(r.value) for r in spark.read.option("pathGlobFilter", "*.json").text(folder).collect()]
    return sorted(found, key=lambda m: m["chunk"])


def committed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of all committed chunks with their chunk."""
    some = chunks(spark, out)
    empty = spark.createDataFrame([], schema).withColumn("chunk", F.lit(0).cast("long"))
    if not some:
        return empty
    rows = spark.read.schema(schema).parquet(*[m["path"] for m in some])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/data/0*([0-9]+)-[0-9a-f]+/[^/]*$", 1).cast("long")
    return rows.withColumn("chunk", number)


def unsound(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """(chunk, rows, found, digest_fits) of the chunks whose data isn't what their manifest says."""
    told = spark.createDataFrame([(m["chunk"], m["rows"], m["digest"]) for m in chunks(spark, out)], "chunk long, rows long, digest long")
    rows = committed(spark, out, schema)
    there = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("found"), F.bit_xor(F.xxhash64(*[c for c in rows.columns if c != "chunk"])).alias("now"))
    both = told.join(there, "chunk", "left").select("chunk", "rows", F.coalesce("found", F.lit(0)).alias("found"), (F.col("digest") == F.coalesce("now", F.lit(0))).alias("digest_fits"))
    return both.where((F.col("rows") != F.col("found")) | ~F.col("digest_fits"))
