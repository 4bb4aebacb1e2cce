"""Scoring of many completions per problem: correctness, pass@k, mean@k, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.base import blank, let
from ..functions.boxed import score_answer
from ..functions.udfs import repeats
from ..functions.text import failure_mode

#: Weights of a right answer, of a box, and of brevity, with its target length (fixed values).
CORRECT, FORMAT, BREVITY, TARGET_TOKENS = 1.0, 0.05, 0.0, 1024


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate that one of k drawn completions is right, c of n being right.

    1 - prod over i in n-c+1 .. n of (1 - k / i), 1 where fewer than k are wrong; c = 0 gives 0.
    """
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (1 - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - product)


def explode_completions(df: DataFrame, completions: str = "completions") -> DataFrame:
    """A row per completion with its index in the problem, problem by problem."""
    return df.select(*[c for c in df.columns if c != completions], F.posexplode(completions).alias("completion_idx", "completion"))


def judge(df: DataFrame, method: str = "boxed", completion: str = "completion", gold: str = "gold") -> DataFrame:
    """Adds extracted and correct, by a benchmark's method."""
    df = df.withColumn("extracted", answers.extract(F.col(completion), method, F.col(gold)))
    return df.withColumn("correct", answers.correct(F.col("extracted"), F.col(gold), method))


def count_correct(df: DataFrame, method: str = "boxed", completions: str = "completions", gold: str = "gold") -> DataFrame:
    """Adds n and c per problem without exploding: the array is judged in place, so nothing is shuffled."""
    right = F.size(F.filter(completions, lambda t: let(answers.extract(t, method, F.col(gold)), lambda x: answers.correct(x, F.col(gold), method))))
    return df.withColumns({"n": F.size(completions), "c": right})


def report(df: DataFrame, ks: tuple[int, ...] = (1, 8), by: tuple[str, ...] = ()) -> DataFrame:
    """One row: n_problems, n_completions and pass_at_k for each k that the uniform n allows, from n and c per problem.

    Problems with differing n, or none, raise an error. With `by`, a row for each group, uniform in itself.
    """
    sized = df.groupBy(*by).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("n_problems"), F.sum("n").alias("n_completions"), *[F.avg(F.when(F.col("n") >= k, pass_at_k(F.col("n"), F.col("c"), k))).alias(f"pass_at_{k}") for k in ks])
    wrong = (F.col("n_problems") == 0) | (F.col("lo") != F.col("hi"))
    checked = F.when(wrong, F.raise_error(F.lit("problems have differing numbers of completions, or there are none")).cast("long")).otherwise(F.col("n_problems"))
    return sized.select(*by, checked.alias("n_problems"), F.col("n_completions").cast("long").alias("n_completions"), *[f"pass_at_{k}" for k in ks])


def mean_at_n(df: DataFrame) -> DataFrame:
    """(n, n_problems, mean_at_n): mean_at_k() of the problems of each number of completions."""
    return df.groupBy("n").agg(F.count(F.lit(1)).alias("n_problems"), F.avg(F.col("c") / F.col("n")).alias("mean_at_n"))


def mean_at_k(df: DataFrame, k: int) -> DataFrame:
    """The mean share of right completions where every problem has k; another n raises an error."""
    rate = F.when(F.col("n") != k, F.raise_error(F.lit(f"a problem doesn't have {k} completions")).cast("double")).otherwise(F.col("c") / F.col("n"))
    return df.agg(F.avg(rate).alias(f"mean_at_{k}"))


def brevity(tokens: Column, target: int = TARGET_TOKENS) -> Column:
    return F.greatest(F.lit(0.0), 1 - tokens / (2.0 * target))


def reward(completion: Column, gold: Column, tokens: Column | None = None, weight: float = BREVITY, target: int = TARGET_TOKENS) -> Column:
    """A right boxed answer, a box that isn't blank, and brevity if right and asked for; equivalence without outer normal form.

    tokens that Python counts must be a column of the frame before, since they can't be part of this expression.
    """
    return let(score_answer(completion), lambda box: reward_of_box(box, gold, tokens, weight, target))


def reward_of_box(box: Column, gold: Column, tokens: Column | None = None, weight: float = BREVITY, target: int = TARGET_TOKENS) -> Column:
    """reward() of an answer that was read before; box and gold must be columns or bound."""
    boxed = ~blank(box)
    right = boxed & F.coalesce(answers.settled(box, gold, answers.equivalent(box, gold)), F.lit(False))
    bonus = F.lit(CORRECT)
    if weight > 0 and tokens is not None:
        bonus = bonus + weight * brevity(tokens, target)
    return F.when(right, bonus).otherwise(F.lit(0.0)) + F.when(boxed, F.lit(FORMAT)).otherwise(F.lit(0.0))


def rewarded(df: DataFrame, completion: str = "completion", gold: str = "gold", tokens: Column | None = None, weight: float = BREVITY, target: int = TARGET_TOKENS) -> DataFrame:
    """Adds extracted and reward, row by row: the answer is a column of its own, so that nothing is bound and interpreted but for rare pairs."""
    df = df.withColumn("extracted", score_answer(F.col(completion)))
    return df.withColumn("reward", reward_of_box(F.col("extracted"), F.col(gold), tokens, weight, target))


def rewards(completions: Column, gold: Column) -> Column:
    return F.transform(completions, lambda t: reward(t, gold))


def solve_rate(c: Column, n: Column) -> Column:
    """c / n; an n below one raises an error."""
    return F.when(n <= 0, F.raise_error(F.lit("a problem has no rollouts")).cast("double")).otherwise(c / n)


def difficulty_band(df: DataFrame, low: float = 0.2, high: float = 0.8, rate: str = "solve_rate") -> DataFrame:
    """Problems whose solve rate lies in the band, both ends included."""
    if not 0 <= low <= high <= 1:
        raise ValueError("a band needs 0 <= low <= high <= 1")
    return df.where(F.col(rate).between(low, high))


def label_failures(df: DataFrame, tokens: str, completion: str = "completion", gold: str = "gold") -> DataFrame:
    """Adds failure_mode and is_correct (the label is `correct`); repetition outranks a right answer."""
    df = judge(df, "boxed", completion, gold)
    mode = failure_mode(repeats(F.col(completion)), F.col("extracted"), F.col("correct"), F.col(tokens), F.col(completion))
    return df.withColumn("failure_mode", mode).withColumn("is_correct", F.col("failure_mode") == "correct")


