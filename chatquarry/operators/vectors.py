"""Settings and weights that must agree, dropped components, keys that only one side has; operators.blocks merges tensors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import seeded_number


def check_weights(weights: Sequence[float]) -> None:
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")


def check_same(settings: Sequence[Mapping], keys: Sequence[str], sets: Sequence[str] = ()) -> None:
    """Every mapping has equal values for the keys, and equal sets for the set-valued ones; else an error."""
    for other in settings[1:]:
        for k in [*keys, *sets]:
            a, b = settings[0].get(k), other.get(k)
            if (set(a or ()) != set(b or ())) if k in sets else a != b:
                raise ValueError(f"settings differ in {k}: {a!r}, {b!r}")


def drop_and_rescale(vectors: DataFrame, key: str, vector: str, p: float, seed: int = 42) -> DataFrame:
    """Each component set to 0 with probability p, the others divided by 1 - p; the choice follows from key and position."""
    if not 0 <= p < 1:
        raise ValueError("p must be in [0, 1)")
    if p == 0:
        return vectors
    keep = lambda i: seeded_number(F.concat_ws(":", F.col(key).cast("string"), i.cast("string")), seed, "drop", 1_000_000) >= int(p * 1_000_000)
    return vectors.withColumn(vector, F.transform(vector, lambda v, i: F.when(keep(i), v / (1 - p)).otherwise(F.lit(0.0))))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two frames has, and which: empty for frames with the same keys."""
    both = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full_outer")
    return both.where("__a is null or __b is null").select(key, F.when(F.col("__b").isNull(), F.lit("first")).otherwise(F.lit("second")).alias("only_in"))
