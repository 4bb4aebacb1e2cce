"""Queries of scoring, rewards, failure modes and their reports over completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, boxed, udfs
from ..functions import text as tx
from ..operators import curate, normalize, report, score
from .registry import query
from .views import COMPLETIONS, RESPONSES, completions, problems, responses, sql_score_answer, table

WITH = f"with {COMPLETIONS.strip()}"


def sql_pass(k: int, n: str = "n", c: str = "c") -> str:
    return f"case when {n} - {c} < {k} then 1.0::double when {c} = 0 then 0.0::double else 1 - list_product(list_transform(range({n} - {c} + 1, {n} + 1), lambda i: 1 - {k}::double / i)) end"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """A row per problem with n and c: judged per completion, then summed; what depends on the problem is a key, so the
    aggregation hashes and needs no shuffle besides the one by problem."""
    rows = score.judge(completions(spark, folder))
    return rows.groupBy("problem_id", "subject", "level", "gold").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"))


_AT = ", ".join(f"round(avg(case when n >= {k} then {sql_pass(k)} end), 6) as pass_at_{k}" for k in (1, 4))


@query(f"{WITH} select subject, count(*) as n_problems, {_AT} from v_prob group by 1")
def pass_at_k_by_subject(spark: SparkSession, folder: str) -> DataFrame:
    """pass@k by subject, over the problems that have k completions."""
    by = scored(spark, folder).groupBy("subject")
    at = lambda k: F.avg(F.when(F.col("n") >= k, score.pass_at_k(F.col("n"), F.col("c"), k)))
    return by.agg(F.count(F.lit(1)).alias("n_problems"), *[F.round(at(k), 6).alias(f"pass_at_{k}") for k in (1, 4)])


@query(f"{WITH} select n, count(*) as n_problems, sum(n)::bigint as n_completions, {_AT} from v_prob group by 1")
def score_generations(spark: SparkSession, folder: str) -> DataFrame:
    """The scorer's path: problems with arrays of completions, judged in place; a report for each number of completions."""
    got = score.report(score.count_correct(problems(spark, folder)), (1, 4), ("n",))
    return got.select(F.col("n").cast("long").alias("n"), "n_problems", "n_completions", *[F.round(f"pass_at_{k}", 6).alias(f"pass_at_{k}") for k in (1, 4)])


@query(f"{WITH} select problem_id, completion_idx, answer as extracted, correct from v_ok")
def score_details(spark: SparkSession, folder: str) -> DataFrame:
    return score.judge(score.explode_completions(problems(spark, folder))).select("problem_id", F.col("completion_idx").cast("long").alias("completion_idx"), "extracted", "correct")


@query(f"{WITH} select n, count(*) as n_problems, round(avg(c / n), 6) as mean_at_n from v_prob group by 1")
def mean_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """mean@k, for the problems of each number of completions."""
    return score.mean_at_n(scored(spark, folder)).withColumn("mean_at_n", F.round("mean_at_n", 6))


#: How an answer may be written (№ and ð stand for two numbers), and the value that it has by the rules.
_FORMS = (
    ("№", "№"), ("№.0", "№"), (" №.00 ", "№"), (r"\$№", "№"), (r"№\%", "№"), ("№%", "№"), (r"№^\circ", "№"), (r"№\text{ cm}", "№"), ("x=№", "№"), (r"\left№\right", "№"),
    (r"\frac{№}{ð}", "№/ð"), (r"\dfrac{№}{ð}", "№/ð"), (r"\frac№ð", "№/ð"), ("№/ð", "№/ð"), (r"\sqrt{№}", "r№"), (r"\sqrt№", "r№"), ("№+ðj", "№+ði"), ("№+ði", "№+ði"),
    ("0.5", "1/2"), (".5", "1/2"), (r"\frac{1}{2}", "1/2"), ("1/2", "1/2"), ("(№,ð)", "(№,ð)"), ("( №, ð )", "(№,ð)"), (r"\infty", "inf"), ("infinity", "inf"),
)


def _sql_written(k: int, form: str, n: str) -> str:
    """The written form (k = 0) or the value (k = 1) of a form's number and its two numbers."""
    listed = "[" + ", ".join("'" + f[k] + "'" for f in _FORMS) + "]"
    return f"replace(replace(({listed})[{form} + 1], '№', {n}::varchar), 'ð', d::varchar)"


_PAIRS = f"""with p as (select l_partkey % {len(_FORMS)} as f, l_suppkey % {len(_FORMS)} as g, l_quantity::int % 8 + 1 as n, l_quantity::int % 8 + 1 + (l_orderkey % 4 = 0)::int as m, l_linenumber + 1 as d from lineitem)
select {_sql_written(0, "f", "n")} as a, {_sql_written(0, "g", "m")} as b, {_sql_written(1, "f", "n")} = {_sql_written(1, "g", "m")} as same, count(*) as rows from p group by all"""


@query(_PAIRS)
def is_equiv_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of answers in many spellings: whole numbers, fractions, roots, units, percents, signs, intervals. Each
    distinct pair is judged once."""
    forms = F.array(*[F.lit(w) for w, _ in _FORMS])
    n, d = F.col("l_quantity").cast("int") % 8 + 1, F.col("l_linenumber") + 1
    written = lambda form, n: F.replace(F.replace(F.get(forms, (form % len(_FORMS)).cast("int")), F.lit("№"), n.cast("string")), F.lit("ð"), d.cast("string"))
    lines = table(spark, folder, "lineitem").select(written(F.col("l_partkey"), n).alias("a"), written(F.col("l_suppkey"), n + (F.col("l_orderkey") % 4 == 0).cast("int")).alias("b"))
    return lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows")).select("a", "b", answers.equivalent(F.col("a"), F.col("b")).alias("same"), "rows")


_REWARD = "(case when answer = gold then 1.0 else 0.0 end + case when answer is not null then 0.05 else 0.0 end + case when answer = gold then 0.1 * greatest(0, 1 - ceil(length(completion) / 4) / 64.0) else 0 end)::double"


@query(f"{WITH} select problem_id, completion_idx, round({_REWARD}, 6) as reward from v_comp")
def reward_per_completion(spark: SparkSession, folder: str) -> DataFrame:
    rows = score.rewarded(completions(spark, folder), tokens=tx.token_estimate(F.col("completion")), weight=0.1, target=32)
    return rows.select("problem_id", F.col("completion_idx").cast("long").alias("completion_idx"), F.round("reward", 6).alias("reward"))


def _python_reward():
    """A reward as a user writes it: set up once a task, then called with completions and what belongs to them by name."""
    import re

    box = re.compile(r"\\boxed\{([^{}]*)\}")

    def reward(completions: list[str], gold: list[str], **_) -> list[float]:
        found = [(box.findall(c) or [None])[-1] for c in completions]
        return [(1.0 if f == g else 0.0) + (0.05 if f is not None else 0.0) + (0.1 * max(0.0, 1 - -(-len(c) // 4) / 64) if f == g else 0.0) for c, f, g in zip(completions, found, gold)]

    return reward


@query(f"{WITH} select problem_id, completion_idx, round({_REWARD}, 6) as reward from v_comp")
def injected_reward(spark: SparkSession, folder: str) -> DataFrame:
    """All completions by a reward function written in Python; its results are the native one's."""
    rows = completions(spark, folder).select("problem_id", F.col("completion_idx").cast("long").alias("completion_idx"), "completion", "gold")
    got = udfs.rewarded(rows, _python_reward, "completion", ["gold"])
    return got.select("problem_id", "completion_idx", F.round("reward", 6).alias("reward"))


_PLAIN = "(case when answer = gold then 1.0 else 0.0 end + case when answer is not null then 0.05 else 0.0 end)::double"


#: A problem with one completion has a second one without an answer, since a variance needs two.
_TWO = "(select problem_id, answer, gold from v_comp union all select problem_id, null, gold from v_prob where n = 1)"


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    """Problems with the rewards of their completions, judged row by row before they are gathered."""
    rows = score.rewarded(completions(spark, folder)).groupBy("problem_id").agg(F.collect_list("reward").alias("rewards"))
    return rows.withColumn("rewards", F.when(F.size("rewards") == 1, F.concat("rewards", F.array(score.reward(F.lit("no answer"), F.lit(""))))).otherwise(F.col("rewards")))


@query(f"{WITH}, r as (select problem_id, var_pop({_PLAIN}) as v, avg({_PLAIN}) as m from {_TWO} group by 1) select count(*) as n_prompts, round(avg(v), 6) as mean_variance, round(avg(m), 6) as mean_reward, round(avg(sqrt(v)), 6) as mean_std from r")
def reward_variance(spark: SparkSession, folder: str) -> DataFrame:
    out = report.reward_variance(_paired(spark, folder))
    return out.select("n_prompts", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"{WITH} select problem_id, gold as answer, round(c / n, 6) as solve_rate from v_prob where c / n between 0.25 and 0.75 order by problem_id limit 500")
def difficulty_band(spark: SparkSession, folder: str) -> DataFrame:
    rated = scored(spark, folder).withColumn("solve_rate", score.solve_rate(F.col("c"), F.col("n")))
    return curate.take_first(score.difficulty_band(rated, 0.25, 0.75), 500, "problem_id").select("problem_id", F.col("gold").alias("answer"), F.round("solve_rate", 6).alias("solve_rate"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Completions with failure_mode and is_correct; the token length is even 4,096 for parts divisible by 7."""
    rows = completions(spark, folder).withColumn("tokens", F.when(F.col("part") % 7 == 0, 4096).otherwise(tx.token_estimate(F.col("completion"))))
    return score.label_failures(rows, "tokens")


LABELLED = f"""{WITH},
v_mode as (select *, case when correct then 'correct' when answer is null then 'no_box' when part % 7 = 0 and not contains(right(completion, 800), '\\boxed') and not contains(right(completion, 800), '\\fbox') then 'truncated' else 'wrong_box' end as mode from v_ok),
v_roll as (select problem_id, any_value(subject) as subject, any_value(level) as level, count(*)::bigint as n_completions, count(*) filter (mode = 'correct')::bigint as n_correct,
  count(*) filter (mode = 'no_box')::bigint as no_box, count(*) filter (mode = 'wrong_box')::bigint as wrong_box, count(*) filter (mode = 'truncated')::bigint as truncated,
  count(*) filter (mode = 'repetition')::bigint as repetition, 0::bigint as other, count(*) filter (mode = 'correct') / count(*) as solve_rate from v_mode group by 1)"""


@query(f"{LABELLED} select problem_id, completion_idx, mode as failure_mode, mode = 'correct' as is_correct from v_mode")
def failure_mode(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select("problem_id", F.col("completion_idx").cast("long").alias("completion_idx"), "failure_mode", "is_correct")


def _rolled(spark: SparkSession, folder: str) -> DataFrame:
    """Per problem with subject and level: the fact table is aggregated before it meets the dimension."""
    rolled = report.per_problem(labelled(spark, folder))
    known = table(spark, folder, "orders").select(F.col("o_orderkey").alias("problem_id"), F.col("o_orderpriority").alias("subject"), F.concat(F.lit("Level "), (F.col("o_custkey") % 5 + 1).cast("string")).alias("level"))
    return rolled.join(known, "problem_id", "left")


@query(f"{LABELLED} select problem_id, n_completions, n_correct, no_box, wrong_box, truncated, repetition, other, round(solve_rate, 6) as solve_rate from v_roll")
def per_problem_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return report.per_problem(labelled(spark, folder)).withColumn("solve_rate", F.round("solve_rate", 6))


_METRICS = "count(*) as n_problems, round(avg(solve_rate), 6) as pass_at_1, round(avg((n_correct > 0)::int), 6) as pass_at_n, sum(no_box)::bigint as no_box, sum(wrong_box)::bigint as wrong_box, sum(truncated)::bigint as truncated, sum(repetition)::bigint as repetition, sum(other)::bigint as other"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("pass_at_1", "pass_at_n")})


@query(f"{LABELLED} select {_METRICS} from v_roll")
def target_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(report.target_summary(report.per_problem(labelled(spark, folder))))


@query(f"{LABELLED} select case when grouping(subject) = 0 then 'subject' else 'level' end as grouping, coalesce(subject, level) as key, {_METRICS} from v_roll group by grouping sets ((subject), (level))")
def subject_level_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(report.breakdown(_rolled(spark, folder), ["subject", "level"]))


@query(f"""{LABELLED}, s as (select subject, sum(no_box) as no_box, sum(wrong_box) as wrong_box, sum(truncated) as truncated, sum(repetition) as repetition, sum(other) as other from v_roll group by 1)
select subject as key, case when greatest(no_box, wrong_box, truncated, repetition, other) = 0 then '(none)' when no_box >= greatest(wrong_box, truncated, repetition, other) then 'no_box'
  when wrong_box >= greatest(truncated, repetition, other) then 'wrong_box' when truncated >= greatest(repetition, other) then 'truncated' when repetition >= other then 'repetition' else 'other' end as dominant from s""")
def dominant_failure_mode(spark: SparkSession, folder: str) -> DataFrame:
    return report.breakdown(_rolled(spark, folder), ["subject"]).select("key", report.dominant().alias("dominant"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-ABSENT")


@query(f"""{LABELLED}, names as (select i as place, n as name from (select unnest(range(6)) as i, unnest({list(_PRIORITIES)}) as n)),
s as (select subject, count(*) as n_problems, avg(solve_rate) as p from v_roll group by 1)
select place, name, coalesce(n_problems, 0) as n_problems, round(coalesce(p, 0), 6) as pass_at_1 from names left join s on name = subject order by coalesce(p, 0), place limit 2""")
def weakest_subjects(spark: SparkSession, folder: str) -> DataFrame:
    by = report.breakdown(_rolled(spark, folder), ["subject"])
    return report.weakest(by, _PRIORITIES).select(F.col("place").cast("long").alias("place"), "name", "n_problems", F.round("pass_at_1", 6).alias("pass_at_1"))


@query(f"{LABELLED} select case when n_correct = 0 then 'never' else 'always' end as solved, count(*) as rows, min(problem_id) as first, max(problem_id) as last from v_roll where n_correct in (0, n_completions) group by 1")
def never_always_solved(spark: SparkSession, folder: str) -> DataFrame:
    some = report.per_problem(labelled(spark, folder)).where("n_correct in (0, n_completions)")
    return some.groupBy(F.when(F.col("n_correct") == 0, F.lit("never")).otherwise(F.lit("always")).alias("solved")).agg(F.count(F.lit(1)).alias("rows"), F.min("problem_id").alias("first"), F.max("problem_id").alias("last"))


@query(f"{WITH} select problem_id as prompt, gold as answer, round(c / n, 6) as engine_v1_pass_at_n, n::int as engine_v1_completions from v_prob where c / n <= 0.25")
def failure_mining(spark: SparkSession, folder: str) -> DataFrame:
    rows = score.count_correct(problems(spark, folder)).select(F.col("problem_id").alias("prompt"), F.col("gold").alias("answer"), "completions", "n", "c")
    out = normalize.failures(rows, "engine_v1", 0.25)
    return out.select("prompt", "answer", F.round("engine_v1_pass_at_n", 6).alias("engine_v1_pass_at_n"), F.size("engine_v1_completions").alias("engine_v1_completions"))


@query(f"{WITH} select round(avg((c / n <= 0.25)::int), 6) as failure_rate from v_prob")
def failure_rate(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).agg(F.round(F.avg((F.col("c") / F.col("n") <= 0.25).cast("int")), 6).alias("failure_rate"))


def _keepers(spark: SparkSession, folder: str) -> DataFrame:
    rows = score.judge(completions(spark, folder)).withColumn("well_formed", tx.well_formed(F.col("completion")))
    return rows.withColumn("kept", F.col("correct") & F.col("well_formed"))


@query(f"{WITH} select problem_id as problem_idx, completion_idx as sample_idx, 'model_1_7b' as source, round(c / n, 6) as teacher_pass_at_n from v_ok join v_prob using (problem_id) where correct and c >= 2")
def distill_keepers(spark: SparkSession, folder: str) -> DataFrame:
    kept = _keepers(spark, folder)
    good = scored(spark, folder).where("c >= 2").select("problem_id", F.round(F.col("c") / F.col("n"), 6).alias("teacher_pass_at_n"))
    return kept.where("kept").join(good, "problem_id").select(F.col("problem_id").alias("problem_idx"), F.col("completion_idx").cast("long").alias("sample_idx"), tx.source_tag(F.lit("org/Model-1.7B")).alias("source"), "teacher_pass_at_n")


@query(f"{WITH} select count(*) as n_problems, round(sum(c) / sum(n), 6) as pass_rate, round((select count(*) from v_comp where answer is not null) / sum(n), 6) as format_rate from v_prob")
def teacher_summary(spark: SparkSession, folder: str) -> DataFrame:
    per = _keepers(spark, folder).groupBy("problem_id").agg(F.count_if("correct").alias("n_correct"), F.count_if("well_formed").alias("n_well_formatted"), F.count(F.lit(1)).alias("n"))
    return report.teacher_summary(per, "n").select("n_problems", F.round("pass_rate", 6).alias("pass_rate"), F.round("format_rate", 6).alias("format_rate"))


@query(f"""{WITH}, w as (select problem_id, count(*) filter (answer is not null)::int as n_well_formatted from v_comp group by 1)
select problem_id::varchar as prompt, gold as answer, (select max(n) from v_prob)::int as n_completions, c::int as n_correct, n_well_formatted from v_prob join w using (problem_id)""")
def teacher_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Completions attached to their problems by id, filled up with empty ones to a uniform number, scored and written out as rows."""
    rows = problems(spark, folder)
    most = rows.agg(F.max(F.size("completions"))).first()[0] or 0
    rows = rows.withColumn("completions", F.concat("completions", F.array_repeat(F.lit(""), F.lit(most) - F.size("completions"))))
    items = rows.select("problem_id", F.col("problem_id").cast("string").alias("prompt"), F.col("gold").alias("answer"))
    both = normalize.attach_completions(items, rows.select("problem_id", "completions"), "problem_id").withColumn("gold", F.col("answer"))
    out = normalize.teacher_rows(score.count_correct(both))
    return out.select("prompt", "answer", F.size("teacher_completions").alias("n_completions"), "n_correct", "n_well_formatted")


@query(f"{WITH} select problem_id as problem_idx, completion_idx as sample_idx, 'model_1_7b' as source, md5(problem_id::varchar || '|' || completion) as messages_md5 from v_ok join v_prob using (problem_id) where correct and c >= 3")
def distilled_rows(spark: SparkSession, folder: str) -> DataFrame:
    good = scored(spark, folder).where("c >= 3").select("problem_id", (F.col("c") / F.col("n")).alias("teacher_pass_at_n"))
    kept = _keepers(spark, folder).where("kept").join(good, "problem_id").select(F.col("problem_id").alias("problem_idx"), F.col("completion_idx").cast("long").alias("sample_idx"), F.col("problem_id").cast("string").alias("prompt"), "completion", "teacher_pass_at_n")
    out = normalize.distilled(kept, "model_1_7b")
    return out.select("problem_idx", "sample_idx", "source", F.md5(F.array_join(F.transform("messages", lambda m: m.content), "|")).alias("messages_md5"))


@query(f"{WITH}, r as (select problem_id, var_pop({_PLAIN}) as v from {_TWO} group by 1) select avg(v) >= 0.01 as passed, round(avg(v), 6) as mean_variance from r")
def variance_check(spark: SparkSession, folder: str) -> DataFrame:
    return report.variance_passes(_paired(spark, folder)).withColumn("mean_variance", F.round("mean_variance", 6))


@query(f"""{WITH}, t as (select problem_id // 50 as chunk, count(*) as attempts, count(*) filter (correct) as correct from v_ok group by 1)
select chunk, sum(attempts) over (order by chunk)::bigint as attempts, sum(correct) over (order by chunk)::bigint as correct from t""")
def chunk_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals by chunk: rows are summed per chunk, chunks in stretches."""
    per = _keepers(spark, folder).groupBy(F.floor(F.col("problem_id") / 50).alias("chunk")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if("correct").alias("correct"))
    return curate.running_totals(per, "chunk", ["attempts", "correct"], 100)


_REPEATS = "(select distinct doc_id from (select doc_id, substr(response, i::bigint, 100) as part from v_resp, unnest(range(1, length(response) - 98)) as r(i) where length(response) >= 300) group by doc_id, part having count(*) >= 3)"


@query(f"with {RESPONSES.strip()} select doc_id, case when doc_id in {_REPEATS} then 'repetition' when {sql_score_answer('response')} is null then 'no_box' when {sql_score_answer('response')} = doc_id::varchar then 'correct' when length(response) > 16356 and not contains(right(response, 800), '\\boxed') and not contains(right(response, 800), '\\fbox') then 'truncated' else 'wrong_box' end as mode from v_resp")
def failure_mode_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Failure modes over all responses, those that repeat a stretch included."""
    rows = responses(spark, folder).select("doc_id", F.col("response").alias("completion"), F.col("doc_id").cast("string").alias("gold"), tx.token_estimate(F.col("response")).alias("tokens"))
    return score.label_failures(rows, "tokens").select("doc_id", F.col("failure_mode").alias("mode"))
