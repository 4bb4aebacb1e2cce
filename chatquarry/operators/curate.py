"""Curation: ordered filters, caps, deduplication, seeded order, sampling, mixing, splits.

Every order-dependent function takes a key to order by; every random one a seed and a key, so that a result doesn't
depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.base import seeded_number, seeded_rank
from ..sources.folders import kept


def reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that doesn't hold, null if all do: kept rows and counts of drops share one scan."""
    first, *rest = rules
    out = F.when(~F.coalesce(first[1], F.lit(False)), F.lit(first[0]))
    for name, holds in rest:
        out = out.when(~F.coalesce(holds, F.lit(False)), F.lit(name))
    return out


def drop_counts(df: DataFrame, column: str = "reason") -> DataFrame:
    """Rows by reason (kept for null) and their share of all: one aggregation with a partial step, one tiny window."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy(F.lit(1))))


def cap_per_key(df: DataFrame, key: str, cap: int, row_id: str, seed: int = 42) -> DataFrame:
    """At most `cap` rows of each key, drawn by seeded rank.

    Long keys are shuffled as two hashes, with equality tested inside the group; the window's limit is pushed below the
    shuffle (a rank-limit), so a hot key sends `cap` rows from each partition.
    """
    if cap <= 0:
        raise ValueError("cap must be positive")
    by = W.partitionBy(F.md5(F.coalesce(F.col(key), F.lit(""))), F.col(key).isNull()).orderBy(seeded_rank(F.col(row_id), seed, "cap"), row_id)
    return df.withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= cap).drop("__k")


def dedup_first(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """The row with the smallest row_id of each key; empty and null keys are dropped.

    The key is evaluated once and shuffled as a hash. Empty keys go after the window, by a test that names its rank, so
    that it can't be pushed below the projection, where it would evaluate the key again.
    """
    by = W.partitionBy("__key").orderBy(row_id)
    empty = F.coalesce(F.col("__key") == F.md5(F.lit("")), F.lit(True))
    return df.withColumn("__key", F.md5(key)).withColumn("__k", F.row_number().over(by)).where(F.col("__k") == 1).where(F.when(empty, None).otherwise(F.col("__k")) == 1).drop("__key", "__k")


def dense_id(df: DataFrame, order_by: str, name: str, start: int = 0, ranges: int = 256) -> DataFrame:
    """Dense ids from `start` in the order of a unique numeric key, without one task that holds all rows.

    The key's approximate quantiles cut it into ranges, fixed before the plan runs; rows are numbered within their
    range, and a range begins after the rows of those before it, a table of one row per range.
    """
    wanted = max(1, min(ranges, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(df.approxQuantile(order_by, [k / wanted for k in range(1, wanted)], 0.01))) if wanted > 1 else []
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    parts = df.withColumn("__range", F.size(F.filter(bounds, lambda b: b <= F.col(order_by))))
    counts = parts.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = parts.withColumn("__k", F.row_number().over(W.partitionBy("__range").orderBy(order_by)) - 1)
    return numbered.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__k") + start).drop("__range", "__k", "__before")


def take_seeded(df: DataFrame, n: int, row_id: str, seed: int = 42) -> DataFrame:
    """The first n rows of the seeded order."""
    return _first(df.withColumn("__r", seeded_rank(F.col(row_id), seed, "shuffle")), n, "__r", row_id).drop("__r")


def take_first(df: DataFrame, n: int, row_id: str) -> DataFrame:
    return _first(df, n, row_id)


#: Rows that one task may gather for a limit.
ONE_TASK = 100_000


def _first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order that has no ties: a top-n per partition, then of those.

    Beyond ONE_TASK rows are numbered in the sorted partitions instead, each after those before it, so that no task
    holds all n. The partitions are written first: their borders are drawn from a sample, and another run of the plan
    could draw others.
    """
    if n <= ONE_TASK:
        return df.orderBy(*order).limit(n)
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = kept(ranged.sortWithinPartitions("__part", *order).withColumn("__row", F.monotonically_increasing_id()), "first")
    sizes = ranged.groupBy("__part").agg(F.min("__row").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("__part", (F.lit(n) - F.coalesce(F.sum("__n").over(before), F.lit(0)) + F.col("__low")).alias("__edge"))
    return ranged.join(F.broadcast(sizes), "__part").where("__row < __edge").drop("__part", "__row", "__edge")


def running_totals(rows: DataFrame, order_by: str, columns: Sequence[str], width: int = 1000) -> DataFrame:
    """Each of the columns summed over the rows up to its own, in the order of a numeric key without repeats, from 0 on.

    Rows are summed within stretches of `width` keys, each stretch after the sum of those before it: the one window
    over all has a row a stretch.
    """
    parts = rows.withColumn("__part", F.floor(F.col(order_by) / width))
    stretch = W.partitionBy("__part").orderBy(order_by).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    out = parts.withColumns({c: F.sum(c).over(stretch) for c in columns}).join(sums, "__part")
    return out.withColumns({c: F.col(c) + F.col(f"__{c}") for c in columns}).drop("__part", *[f"__{c}" for c in columns])


def split_train_eval(df: DataFrame, n_eval: int, row_id: str, seed: int = 42) -> DataFrame:
    """Adds split: the first n_eval rows of the seeded order are eval, the rest train; fewer rows than that are an error.

    Only the n_eval ranks are gathered; the last of them is the boundary that all rows are compared with.
    """
    rank = seeded_rank(F.col(row_id), seed, "shuffle")
    marked = df.withColumn("__r", F.struct(rank.alias("r"), F.col(row_id).alias("i")))
    edge = marked.select("__r").orderBy("__r").limit(n_eval).agg(F.max("__r").alias("__e"), F.count(F.lit(1)).alias("__n"))
    few = F.raise_error(F.concat(F.lit(f"{n_eval} rows for eval are more than there are: "), F.col("__n").cast("string"))).cast("boolean")
    edge = edge.where(F.when(F.col("__n") < n_eval, few).otherwise(F.lit(True))).drop("__n")
    return marked.crossJoin(F.broadcast(edge)).withColumn("split", F.when(F.col("__r") <= F.col("__e"), F.lit("eval")).otherwise(F.lit("train"))).drop("__r", "__e")


def oversample(df: DataFrame, target: int, row_id: str, seed: int = 42, salt: str = "bucket") -> DataFrame:
    """Exactly `target` rows drawn with replacement, each with its draw number; an empty pool gives none.

    Rows get dense positions; draw k takes position hash(k) % pool, an equi-join.
    """
    pool = dense_id(df, row_id, "__pos")
    size = df.agg(F.count(F.lit(1)).alias("__size"))
    draws = df.sparkSession.range(target).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size)).where("__size > 0")
    draws = draws.withColumn("__pos", seeded_number(F.col("draw"), seed, salt, F.col("__size"))).drop("__size")
    return draws.join(pool, "__pos").drop("__pos")


def mix_two(first: DataFrame, second: DataFrame, n: int, share: float, row_id: str, seed: int = 42) -> DataFrame:
    """n rows of two sources with the same columns: round-half-even(n * share) of the first, the rest of the second."""
    a = round(n * share)
    return take_seeded(first, a, row_id, seed).unionByName(take_seeded(second, n - a, row_id, seed))


def bucket_mix(base: DataFrame, base_n: int, buckets: Sequence[tuple[str, Column, int]], pool: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """A seeded sample of `base` with oversampled, possibly overlapping buckets of `pool`; duplicates stay."""
    out = take_seeded(base, base_n, row_id, seed).withColumn("bucket", F.lit("base"))
    for name, member, target in buckets:
        out = out.unionByName(oversample(pool.where(member), target, row_id, seed, name).drop("draw").withColumn("bucket", F.lit(name)))
    return out


def concat(*frames: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A bag union; with columns, of these."""
    first, *rest = [f.select(*columns) if columns else f for f in frames]
    for f in rest:
        first = first.unionByName(f)
    return first


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that aren't in b, counted as a bag."""
    return a.exceptAll(b)


def aligned(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Rows of two frames with the same id, one to one; an id that only one has raises an error."""
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), row_id, "full_outer")
    lone = F.col("__a").isNull() | F.col("__b").isNull()
    checked = F.when(lone, F.raise_error(F.concat(F.lit("no counterpart of row "), F.col(row_id).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(checked).drop("__a", "__b")


def resolve_sizes(n_samples: int | None, train_size: int | None, n_eval: int, default: int = 50_000) -> int:
    """Rows to draw: n_samples as given, or train_size and the eval rows besides; both is an error."""
    if n_samples is not None and train_size is not None:
        raise ValueError("give n_samples or train_size, not both")
    return train_size + n_eval if train_size is not None else default if n_samples is None else n_samples


def small_pool(pool: int, target: int, times: int = 5) -> bool:
    """The target repeats each row of the pool more than `times` times on average."""
    return target > times * max(pool, 1)
