"""Rows of each source as rows of one model. Every function returns a plan; none collects; `keep` names columns that stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import base, boxed, chat
from ..functions import text as tx


def generated(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Generated solutions: query, and response with the expected answer boxed at the end."""
    box = F.concat(base.rstrip(F.col("generated_solution")), F.lit("\n\n\\boxed{"), F.col("expected_answer").cast("string"), F.lit("}"))
    return df.select(*keep, F.col("problem").alias("query"), box.alias("response"))


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def leveled(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Levelled problems: query, response, subject, level. Without a box the answer column is boxed; without both the row goes."""
    answer, solution = _has(df, "answer"), F.col("solution")
    plain = base.let(boxed.split_box(solution), lambda p: F.when(p.isNotNull(), solution).when(~base.blank(answer), F.concat(base.rstrip(solution), F.lit("\n\n\\boxed{"), base.strip(answer), F.lit("}"))))
    out = df.where(~base.blank(F.col("problem")) & solution.isNotNull())
    return out.select(*keep, F.col("problem").alias("query"), plain.alias("response"), tx.subject_of(_has(df, "type"), _has(df, "subject")).alias("subject"), tx.level_of_training(F.col("level").cast("string")).alias("level")).where("response is not null")


def olympiad(df: DataFrame, sources: Sequence[str] = tx.OLYMPIADS, keep: Sequence[str] = ()) -> DataFrame:
    """Problems of admitted sources whose solution has a box: query, response. The filter comes first, near the scan."""
    out = df.where(F.col("source").isin(list(sources))).where(~base.blank(F.col("problem")))
    return out.where(boxed.split_box(F.col("solution")).isNotNull()).select(*keep, F.col("problem").alias("query"), F.col("solution").alias("response"))


def test_rows(df: DataFrame, order_by: str, prefix: str = "math_test_") -> DataFrame:
    """Test problems: problem_id (dense, by order_by), problem, gold_answer, subject, level; answer before the solution's box."""
    from .curate import dense_id

    gold = F.coalesce(base.falsy(_has(df, "answer")), boxed.score_answer(_has(df, "solution")))
    ids = dense_id(df, order_by, "i")
    return ids.select(
        F.concat(F.lit(prefix), F.col("i").cast("string")).alias("problem_id"), "problem", gold.alias("gold_answer"),
        tx.subject_of(_has(df, "subject"), _has(df, "type")).alias("subject"), tx.level_of_test(F.col("level").cast("string")).alias("level"),
    ).where("gold_answer is not null")


def leveled_problems(df: DataFrame, levels: Sequence[str] = ("Level 4", "Level 5"), subjects: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Levelled problems of given levels and subject slugs with a boxed answer: prompt, answer, subject, level, trimmed."""
    level = tx.level_of_extraction(F.col("level").cast("string"))
    subject = F.coalesce(base.falsy(_has(df, "subject")), base.falsy(_has(df, "type")))
    wanted = level.isin(list(levels))
    if subjects is not None:
        wanted &= tx.subject_slug(subject).isin(list(subjects))
    out = df.where(wanted).select(*keep, base.strip(F.col("problem")).alias("prompt"), base.strip(boxed.level_box(F.col("solution"))).alias("answer"), base.strip(subject).alias("subject"), level.alias("level"))
    return out.where((F.col("prompt") != "") & (F.col("answer") != ""))


def either_schema(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """prompt, answer from rows with prompt and answer (or reference), or with messages; other rows raise an error."""
    names = set(df.columns)
    pick = lambda *c: F.coalesce(*[F.col(x).cast("string") for x in c if x in names], F.lit(None).cast("string"))
    prompt, answer = pick("prompt"), pick("answer", "reference")
    if "messages" in names:
        both = chat.prompt_and_gold(F.col("messages"))
        prompt, answer = F.coalesce(prompt, both.prompt), F.coalesce(answer, both.gold)
    need = lambda c: F.when(c.isNull(), F.raise_error(F.lit("a row has neither prompt and answer nor valid messages")).cast("string")).otherwise(c)
    return df.select(*keep, need(prompt).alias("prompt"), need(answer).alias("answer"))


def pool(df: DataFrame) -> DataFrame:
    """prompt, gold of the valid conversations of a pool; the others are dropped."""
    return df.withColumn("__p", chat.prompt_and_gold(F.col("messages"))).where("__p is not null").select(*[c for c in df.columns if c != "messages"], "__p.prompt", "__p.gold")


def gold_of(df: DataFrame) -> Column:
    """reference before answer, where both are columns."""
    return F.coalesce(*[F.col(c).cast("string") for c in ("reference", "answer") if c in df.columns])


def reward_prompts(df: DataFrame, rendered: str = "prompt") -> DataFrame:
    """prompt, answer, solve_rate; a prompt that isn't templated raises an error."""
    ok = chat.templated(F.col(rendered))
    return df.select(F.when(ok, F.col(rendered)).otherwise(F.raise_error(F.lit("a prompt is not templated")).cast("string")).alias("prompt"), "answer", F.col("solve_rate").cast("double").alias("solve_rate"))


def failures(df: DataFrame, tag: str, threshold: float = 0.0) -> DataFrame:
    """prompt, answer, <tag>_pass_at_n, <tag>_completions of problems (c of n right) whose rate is the threshold at most."""
    rate = F.col("c") / F.col("n")
    return df.where((F.col("n") > 0) & (rate <= threshold)).select("prompt", "answer", rate.alias(f"{tag}_pass_at_n"), F.col("completions").alias(f"{tag}_completions"))


def attach_completions(items: DataFrame, completions: DataFrame, row_id: str) -> DataFrame:
    """row_id, prompt, answer, completions: one to one by id; lone rows and differing numbers of completions are errors."""
    from .curate import aligned

    both = aligned(items.select(row_id, "prompt", "answer"), completions.select(row_id, "completions"), row_id)
    sizes = completions.agg(F.min(F.size("completions")).alias("__lo"), F.max(F.size("completions")).alias("__hi"))
    uniform = F.when(F.col("__lo") == F.col("__hi"), F.lit(True)).otherwise(F.raise_error(F.lit("the number of completions must be uniform")).cast("boolean"))
    return both.crossJoin(F.broadcast(sizes)).where(uniform).drop("__lo", "__hi")  # one row of sizes


def teacher_rows(scored: DataFrame) -> DataFrame:
    """prompt, answer, teacher_completions, n_correct, n_well_formatted of problems that count_correct() has scored."""
    good = F.size(F.filter("completions", tx.well_formed))
    return scored.select("prompt", "answer", F.col("completions").alias("teacher_completions"), F.col("c").alias("n_correct"), good.alias("n_well_formatted"))


def distilled(kept: DataFrame, source: str) -> DataFrame:
    """messages, source, problem_idx, sample_idx, teacher_pass_at_n of kept samples (prompt, completion and the rest)."""
    messages = F.array(chat.message("user", F.col("prompt")), chat.message("assistant", base.strip(F.col("completion"))))
    return kept.select(messages.alias("messages"), F.lit(source).alias("source"), "problem_idx", "sample_idx", F.col("teacher_pass_at_n").cast("double").alias("teacher_pass_at_n"))


def assert_templated(df: DataFrame, prompt: str, order_by: str, rows: int = 5) -> None:
    """An error if one of the first rows isn't a templated prompt; looks at so many rows, on the driver."""
    bad = df.select(prompt, order_by).orderBy(order_by).limit(rows).where(~chat.templated(F.col(prompt))).limit(1).collect()
    if bad:
        raise ValueError(f"a prompt is not templated: {bad[0][prompt][:80]!r}")
