"""Rollups of scored completions: per problem, per target, by subject and level, failure modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import falsy
from ..functions.text import FAILURES


def _mode() -> Column:
    return F.when(F.col("failure_mode").isin(*FAILURES[:-1], "correct"), F.col("failure_mode")).otherwise(F.lit("other"))


def per_problem(facts: DataFrame, problems: DataFrame | None = None, key: str = "problem_id") -> DataFrame:
    """key, n_completions, n_correct, solve_rate (0 without completions) and a count per failure mode.

    With a table of problems those without completions have a row of zeros.
    """
    out = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n_completions"), F.count_if("is_correct").alias("n_correct"), *[F.count_if(_mode() == m).alias(m) for m in FAILURES])
    if problems is not None:
        out = problems.select(key).join(out, key, "left").na.fill(0)
    return out.withColumn("solve_rate", F.when(F.col("n_completions") > 0, F.col("n_correct") / F.col("n_completions")).otherwise(F.lit(0.0)))


def _metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_problems"), F.coalesce(F.avg("solve_rate"), F.lit(0.0)).alias("pass_at_1"),
        F.coalesce(F.avg((F.col("n_correct") > 0).cast("double")), F.lit(0.0)).alias("pass_at_n"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in FAILURES],
    ]


def target_summary(problems: DataFrame) -> DataFrame:
    """One row over all problems; zeros where there are none."""
    return problems.agg(*_metrics())


def breakdown(problems: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The metrics by each field: grouping, key and metrics, in one pass over the problems; null and empty are Unknown."""
    filled = problems.withColumns({f: F.coalesce(falsy(F.col(f)), F.lit("Unknown")) for f in fields})
    out = filled.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(*_metrics(), *[F.grouping(f).alias(f"__{f}") for f in fields])
    grouping, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        grouping, key = F.when(F.col(f"__{f}") == 0, F.lit(f)).otherwise(grouping), F.when(F.col(f"__{f}") == 0, F.col(f)).otherwise(key)
    return out.select(grouping.alias("grouping"), key.alias("key"), "n_problems", "pass_at_1", "pass_at_n", *FAILURES)


def level_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows by each field, in one pass."""
    out = df.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.count(F.lit(1)).alias("rows"), *[F.grouping(f).alias(f"__{f}") for f in fields])
    grouping, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        grouping, key = F.when(F.col(f"__{f}") == 0, F.lit(f)).otherwise(grouping), F.when(F.col(f"__{f}") == 0, F.col(f)).otherwise(key)
    return out.select(grouping.alias("grouping"), key.alias("key"), "rows")


def dominant(modes: Sequence[str] = FAILURES) -> Column:
    """The failure mode with the largest count, the first of equals; (none) where all are 0."""
    top = F.greatest(*[F.col(m) for m in modes])
    out = F.when(top == 0, F.lit("(none)"))
    for m in modes:
        out = out.when(F.col(m) == top, F.lit(m))
    return out


def weakest(by_key: DataFrame, names: Sequence[str], k: int = 2, key: str = "key", metric: str = "pass_at_1") -> DataFrame:
    """The k names with the lowest metric, earlier names first among equals; names without rows count as 0 problems and are shown."""
    spark = by_key.sparkSession
    order = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, name string")
    out = F.broadcast(order).join(by_key, F.col("name") == F.col(key), "left").select("place", "name", F.coalesce("n_problems", F.lit(0)).alias("n_problems"), F.coalesce(F.col(metric), F.lit(0.0)).alias(metric))
    return out.orderBy(metric, "place").limit(k)


def reward_variance(df: DataFrame, rewards: str = "rewards") -> DataFrame:
    """The mean over prompts of the population variance of their rewards; a prompt with under two raises an error."""
    mean = F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x) / F.size(rewards)
    spread = F.aggregate(F.transform(rewards, lambda x: F.pow(x - F.col("__mean"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x) / F.size(rewards)
    some = df.where(F.when(F.size(rewards) < 2, F.raise_error(F.lit("a prompt has under two rewards")).cast("boolean")).otherwise(F.lit(True)))
    return some.withColumn("__mean", mean).withColumn("__var", spread).agg(F.count(F.lit(1)).alias("n_prompts"), F.avg("__var").alias("mean_variance"), F.avg("__mean").alias("mean_reward"), F.avg(F.sqrt("__var")).alias("mean_std"))


def variance_passes(df: DataFrame, threshold: float = 0.01, rewards: str = "rewards") -> DataFrame:
    """One row: passed (the mean variance is the threshold at least) and mean_variance; no prompts is an error."""
    out = reward_variance(df, rewards)
    mean = F.when(F.col("n_prompts") == 0, F.raise_error(F.lit("there are no prompts")).cast("double")).otherwise(F.col("mean_variance"))
    return out.select((mean >= threshold).alias("passed"), mean.alias("mean_variance"))


def teacher_summary(df: DataFrame, n: int | str) -> DataFrame:
    """Share of right and of well-formed completions, from n_correct and n_well_formatted per problem; 0 without problems.

    n is the number of completions of every problem, or the column that has it.
    """
    every = F.sum(n) if isinstance(n, str) else F.count(F.lit(1)) * n
    rate = lambda c: F.coalesce(F.sum(c) / F.nullif(every, F.lit(0)), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n_problems"), rate("n_correct").alias("pass_rate"), rate("n_well_formatted").alias("format_rate"))
