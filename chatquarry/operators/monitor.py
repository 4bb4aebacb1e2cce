"""Signals of a training log: rolling means over rows, spikes, the latest checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the rolling mean, its level, and the steps from which it warns and errs; the spike's level and last step (fixed values).
SIGNAL_ROWS, SIGNAL_LEVEL, WARN_STEP, ERROR_STEP = 50, 0.5, 100, 200
KL_LEVEL, KL_STEPS = 0.5, 100


def alert(step: Column, mean: Column) -> Column:
    high = mean > SIGNAL_LEVEL
    return F.when(high & (step >= ERROR_STEP), F.lit("error")).when(high & (step >= WARN_STEP), F.lit("warn")).otherwise(F.lit("ok"))


def rolling_signal(log: DataFrame, run: str, step: str = "step", value: str = "value", rows: int = SIGNAL_ROWS) -> DataFrame:
    """Adds rolling_mean over the last rows of a run that have a value, and alert; runs are the partitions."""
    by = W.partitionBy(run).orderBy(step).rowsBetween(1 - rows, 0)
    out = log.where(F.col(value).isNotNull()).withColumn("rolling_mean", F.avg(value).over(by))
    return out.withColumn("alert", alert(F.col(step), F.col("rolling_mean")))


def kl_spike(step: Column, kl: Column) -> Column:
    return F.coalesce((step < KL_STEPS) & (kl > KL_LEVEL), F.lit(False))


def latest_checkpoint(names: DataFrame, name: str = "name", by: list[str] | None = None) -> DataFrame:
    """The checkpoint with the largest numeric suffix; other names don't count."""
    n = F.try_to_number(F.regexp_extract(name, r"^checkpoint-([0-9]+)$", 1), F.lit("999999999999999999")).cast("long")
    some = names.withColumn("__n", n).where("__n is not null")
    return some.groupBy(*(by or [])).agg(F.max_by(name, "__n").alias("latest"))
