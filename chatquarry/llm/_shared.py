"""Helpers that the operators of this subpackage share: reading tables, scratch tables, hashes, groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of this subpackage are read with it as a separator of words: space and \x09-\x0D.
NON_SPACE = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that may be broadcast, after both have been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Rows of a batch that goes to Python; texts can be long, and a batch is held on both sides.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable, kind: str) -> DataFrame:
    """df.mapInArrow() in batches of ARROW_ROWS rows at most.

    Spark has no such bound for one plan, so the session's is lowered; a smaller one stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df.mapInArrow(run, kind)


def kind_of(df: DataFrame, column: str) -> str:
    """A column's type, as it is written in a schema."""
    return df.select(F.col(column)).schema[0].dataType.simpleString()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session has one of this process's own.

    On a cluster executors don't see such a folder, so an unset option is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="chatquarry-"))
    return found.rstrip("/")


_OWN: dict[str, str] = {}


def narrow(df: DataFrame, each: int = 2) -> DataFrame:
    """A result of few bytes per row in `each` partitions a core at most, not in a small file per shuffle partition."""
    return df.coalesce(max(2, each * df.sparkSession.sparkContext.defaultParallelism))


class Scratch:
    """Tables written to the shared folder to cut lineage: each is computed once and survives the loss of an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def path(self, name: str = "table") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "table", wide: bool = False, each: int = 1) -> DataFrame:
        """Writes df and reads it again. Unless it is wide, as the input's rows are, it has `each` files a core at most."""
        (df if wide else narrow(df, each)).write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables which no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes (both are measured), else as it is, for a shuffled join."""
    n, size = measure(df)
    return F.broadcast(df) if n <= rows and size <= most_bytes else df


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of df: 16 for each value, and the length of texts, binaries and, as JSON, nested values."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.sum(total)).first()
    return n, size or 0


def crc_of(column: str) -> Column:
    """crc32 of an id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def hash_order(*columns: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def sub_batches(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have so many bytes at most; a longer text comes alone."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    size = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64))
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Groups of rows that follow each other with equal keys; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            here = tuple(c[a] for c in columns)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); every round is a table in the shared
    folder, and it ends when a round changes nothing. Nodes without edges have no row.
    """
    pairs = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = both.join(least, "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    before = mark(pairs)
    while before[0]:
        after = scratch.keep(star(star(pairs, True), False), "stars")
        now = mark(after)
        scratch.drop(pairs)
        pairs = after
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_pairs(rows: DataFrame, block_rows: int, block_weight: int) -> DataFrame:
    """Deals rows (id long, keys array<long>, weight long) out so that ids that share a key meet in bounded blocks.

    A key's ids are cut into blocks of about block_rows rows and block_weight in all; a task is one pair of blocks
    (one block with itself included). Keys with the same set of ids as a smaller key are left out, so two ids always
    meet at the smallest key that they share. Returns (id, tasks array<struct<key, i, j, blk>>); ids that share no
    key with another have no row.
    """
    long = rows.select("id", "weight", F.explode(F.array_distinct("keys")).alias("key"))
    lists = long.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"),
        F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("s2"),
    ).where("n > 1")
    kept = lists.groupBy("n", "w", "s1", "s2").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("n") / block_rows, F.col("w") / block_weight, F.lit(1))).cast("int")
    kept = kept.select("key", blocks.alias("nb"))
    met = long.select("id", "key").join(kept, "key").withColumn("blk", F.pmod(F.xxhash64("id", "key"), F.col("nb")).cast("int"))
    return met.select("id", F.struct("key", "blk", "nb").alias("t")).groupBy("id").agg(F.collect_list("t").alias("tasks"))


def deal(met: DataFrame, payload: list[str]) -> DataFrame:
    """Rows of block_pairs() with their payload, once for each task they take part in, sorted by task within partitions."""
    one = met.select("id", *payload, F.explode("tasks").alias("t"))
    each = F.transform(F.sequence(F.lit(0), F.col("t.nb") - 1), lambda x: F.struct(F.least(x, F.col("t.blk")).alias("i"), F.greatest(x, F.col("t.blk")).alias("j")))
    out = one.select("id", *payload, F.col("t.key").alias("key"), F.col("t.blk").alias("blk"), F.explode(each).alias("p"))
    return by_task(out.select("id", *payload, "key", "blk", "p.i", "p.j"))


def by_task(rows: DataFrame) -> DataFrame:
    """The rows (key, i, j, ...) of each task together, in one partition and one after the other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")


#: What is left of a task's rows once its candidates are known: (id, task, block).
ALIVE = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("blk", pa.int32())])
ALIVE_KIND = "id long, key long, i int, j int, blk int"


def alive(group: pa.Table, rows: np.ndarray) -> pa.RecordBatch:
    """Those rows of a task, without their payload."""
    some = group.select(ALIVE.names).take(pa.array(rows)).cast(ALIVE).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in some.columns], schema=ALIVE)


def links_of(found: DataFrame) -> DataFrame:
    """Links of (id, root) summed over tasks, so that the tasks that verify pairs stay as many as they are."""
    return found.groupBy("id", "root").agg(F.sum("links").alias("links"))


def stars(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links left[k]-right[k] (positions in ids): links of each position, and the smallest id its links reach."""
    n = len(ids)
    count = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        if (new == root).all():
            return count, root
        root = new
