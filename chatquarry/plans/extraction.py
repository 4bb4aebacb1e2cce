"""Queries of extraction and of the text kernel over documents with appended answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, base, boxed, subwords, udfs
from ..functions import text as tx
from ..operators import curate, normalize
from .registry import query
from .views import RESPONSES, responses, sql_level_box, sql_score_answer, sql_split_box, sql_strip_preamble, table

#: Thresholds of the filter chain (fixed values).
MAX_RESPONSE, MAX_ANSWER, MIN_REASONING = 8000, 200, 150
_BEFORE, _INSIDE = sql_split_box("response")
WITH = f"with {RESPONSES.strip()}"


@query("select doc_id, text as query, n_chars from documents")
def source_projection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.col("text").alias("query"), "n_chars")


@query(f"{WITH} select doc_id, {sql_score_answer('response')} as answer, {sql_score_answer('response', False)} as raw from v_resp")
def boxed_score(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", boxed.score_answer(F.col("response")).alias("answer"), boxed.score_answer(F.col("response"), peel=False).alias("raw"))


@query(f"{WITH} select doc_id, length({_BEFORE}) as before_chars, {_INSIDE} as inside from v_resp")
def boxed_split(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).withColumn("p", boxed.split_box(F.col("response"))).select("doc_id", F.length("p.before").cast("long").alias("before_chars"), F.col("p.inside").alias("inside"))


@query(f"{WITH} select doc_id, {sql_level_box('response')} as answer from v_resp")
def boxed_level(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", boxed.level_box(F.col("response")).alias("answer"))


@query(f"{WITH}, b as (select doc_id, {_BEFORE} as before from v_resp) select doc_id, md5({sql_strip_preamble('before')}) as reasoning_md5 from b")
def strip_preamble(spark: SparkSession, folder: str) -> DataFrame:
    before = boxed.split_box(F.col("response")).before
    return responses(spark, folder).select("doc_id", F.md5(boxed.strip_preamble(before)).alias("reasoning_md5"))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, query, reasoning, inside, and the first rule of the filter chain that fails."""
    rows = responses(spark, folder).withColumn("p", F.when(F.length("response") <= MAX_RESPONSE, boxed.split_box(F.col("response"))))
    rows = rows.withColumn("reasoning", boxed.strip_preamble(F.col("p.before")))
    rules = [
        ("too_long", F.length("response") <= MAX_RESPONSE), ("no_box", F.col("p").isNotNull()),
        ("long_answer", F.length("p.inside") <= MAX_ANSWER), ("short_reasoning", F.length("reasoning") >= MIN_REASONING),
    ]
    return rows.select("doc_id", "query", "lang", "source", "reasoning", F.col("p.before").alias("before"), F.col("p.inside").alias("inside"), curate.reason(rules).alias("reason"))


STAGED = f"""{WITH},
v_split as (select doc_id, query, lang, source, response, {_BEFORE} as before, {_INSIDE} as inside from v_resp),
v_clean as (select *, {sql_strip_preamble("before")} as reasoning from v_split),
v_stage as (select *, case when length(response) > {MAX_RESPONSE} then 'too_long' when inside is null then 'no_box' when length(inside) > {MAX_ANSWER} then 'long_answer'
  when length(reasoning) < {MIN_REASONING} then 'short_reasoning' end as reason from v_clean)"""


@query(f"{STAGED} select coalesce(reason, 'kept') as reason, count(*) as rows, round(count(*) / sum(count(*)) over (), 6) as share from v_stage group by 1")
def filter_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return curate.drop_counts(staged(spark, folder)).select("reason", "rows", F.round("share", 6).alias("share"))


@query(f"{STAGED} select count(*) as rows, round(avg((rtrim(before, ' ' || chr(10) || chr(9)) <> reasoning)::int), 6) as fired from v_stage where reason is null or reason = 'short_reasoning'")
def strip_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(spark, folder).where("reason is null or reason = 'short_reasoning'")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((base.rstrip(F.col("before")) != F.col("reasoning")).cast("int")), 6).alias("fired"))


@query()
def subword_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of at most 1,000 tokens by a public vocabulary, and the tokens' share of the estimate's."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        count = subwords.subwords(subwords.ranks_of(f.read()), public_tokenizers.PATTERN)
    rows = responses(spark, folder).select("doc_id", count(F.col("response")).alias("tokens"), tx.token_estimate(F.col("response")).alias("estimate"))
    return rows.where("tokens <= 1000").select("doc_id", "tokens", F.round(F.col("tokens") / F.greatest("estimate", F.lit(1)), 6).alias("ratio"))


@query(f"{WITH} select doc_id, ceil(length(response) / 4)::int as tokens from v_resp where ceil(length(response) / 4) <= 1000")
def token_filter(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select("doc_id", tx.token_estimate(F.col("response")).alias("tokens")).where("tokens <= 1000")


@query(f"{WITH} select lang, count(*) as rows, count(*) filter (ceil(length(response) / 4) > 1000) as dropped, count(*) filter (ceil(length(response) / 4) > 1000) > 0.05 * count(*) as warn from v_resp group by 1")
def drop_rate_report(spark: SparkSession, folder: str) -> DataFrame:
    long = tx.token_estimate(F.col("response")) > 1000
    return responses(spark, folder).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(long).alias("dropped")).withColumn("warn", F.col("dropped") > 0.05 * F.col("rows"))


@query("select p_partkey as id, p_name || ' ' || p_type as query, rtrim(p_name || '  ') || chr(10) || chr(10) || '\\boxed{' || p_size || '}' as response from part")
def normalize_generated(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("problem"), F.concat("p_name", F.lit("  ")).alias("generated_solution"), F.col("p_size").alias("expected_answer"))
    return normalize.generated(rows, ["id"])


_LEVELS = "case doc_id % 4 when 0 then '' || (doc_id % 5 + 1) when 1 then 'Level ' || (doc_id % 5 + 1) when 2 then '  ' else 'Level ?' end"


def _leveled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as levelled problems: level in four spellings, type and subject partly empty, an answer beside the solution."""
    d = F.col("doc_id")
    number = (d % 5 + 1).cast("string")
    level = F.when(d % 4 == 0, number).when(d % 4 == 1, F.concat(F.lit("Level "), number)).when(d % 4 == 2, F.lit("  ")).otherwise(F.lit("Level ?"))
    kind = F.when(d % 3 == 0, F.lit("")).when(d % 3 == 1, F.lit("Counting and Probability")).otherwise(F.lit("Algebra"))
    return responses(spark, folder).select("doc_id", F.col("query").alias("problem"), F.col("response").alias("solution"), level.alias("level"), kind.alias("type"), F.col("source").alias("subject"), F.when(d % 2 == 0, number).alias("answer"))


LEVELED = f"""{WITH},
v_lev as (select doc_id, query as problem, response as solution, {_LEVELS} as level, case doc_id % 3 when 0 then '' when 1 then 'Counting and Probability' else 'Algebra' end as type,
  source as subject, case when doc_id % 2 = 0 then '' || (doc_id % 5 + 1) end as answer from v_resp)"""
_AMP = "case when {0} = 'Counting and Probability' then 'Counting & Probability' else {0} end"
_S_BEFORE, _S_INSIDE = sql_split_box("solution")


@query(f"""{LEVELED}, x as (select *, {_S_INSIDE} as inside from v_lev)
select doc_id, md5(case when inside is not null then solution else rtrim(solution) || chr(10) || chr(10) || '\\boxed{{' || answer || '}}' end) as response_md5,
  {_AMP.format("coalesce(nullif(type, ''), nullif(subject, ''))")} as subject,
  case when trim(level) = '' then null when regexp_full_match(trim(level), '[0-9]+') then 'Level ' || trim(level) else trim(level) end as level
from x where inside is not null or answer is not null""")
def normalize_leveled(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.leveled(_leveled(spark, folder), ["doc_id"]).select("doc_id", F.md5("response").alias("response_md5"), "subject", "level")


_L_BOX = sql_level_box("solution")


@query(f"""{LEVELED}, x as (select *, {_L_BOX} as a, case when trim(level) in ('', 'Level ?') then null when starts_with(trim(level), 'Level ') then trim(level) else 'Level ' || trim(level) end as l,
  coalesce(nullif(subject, ''), nullif(type, '')) as s from v_lev)
select doc_id, trim(a) as answer, s as subject, l as level from x where l in ('Level 4', 'Level 5') and replace(replace(lower(trim(s)), ' ', '_'), '&', 'and') in ('src1', 'src2', 'src3', 'src4', 'src5') and trim(a) <> '' and trim(problem) <> ''""")
def level_subject_filter(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.leveled_problems(_leveled(spark, folder), tx.parse_levels("4,5"), ["src1", "src2", "src3", "src4", "src5"], ["doc_id"]).drop("prompt")


@query("""select case when grouping(p_type) = 0 then 'subject' else 'level' end as grouping, coalesce(p_type, level) as key, count(*) as rows
from (select p_type, 'Level ' || (p_size % 5 + 1) as level from part) group by grouping sets ((p_type), (level))""")
def level_subject_counts(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators import report

    rows = table(spark, folder, "part").select(F.col("p_type").alias("subject"), F.concat(F.lit("Level "), (F.col("p_size") % 5 + 1).cast("string")).alias("level"))
    return report.level_counts(rows, ["subject", "level"])


@query(f"{WITH} select doc_id, {_INSIDE} as answer from v_resp where source in ('src1', 'src3', 'src5', 'src7') and trim(query) <> '' and {_INSIDE} is not null")
def allowlist_source(spark: SparkSession, folder: str) -> DataFrame:
    rows = responses(spark, folder).select("doc_id", F.col("query").alias("problem"), F.col("response").alias("solution"), "source")
    return normalize.olympiad(rows, ("src1", "src3", "src5", "src7"), ["doc_id"]).select("doc_id", boxed.split_box(F.col("response")).inside.alias("answer"))


@query(f"""{LEVELED}, x as (select *, coalesce(nullif(answer, ''), {sql_score_answer("solution")}) as gold from v_lev)
select 'math_test_' || (row_number() over (order by doc_id) - 1) as problem_id, gold as gold_answer, {_AMP.format("coalesce(nullif(subject, ''), nullif(type, ''))")} as subject,
  case when level = '' then null when starts_with(level, 'Level ') then level else 'Level ' || level end as level from x qualify gold is not null""")
def normalize_test_rows(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.test_rows(_leveled(spark, folder), "doc_id").drop("problem")


_ANSWERS = ["42", " 1,000 ", "\\frac12", "\\dfrac{3}{4}", "1/2", "0.5", "x=5", "5.00", "\\text{red}", "10\\%", "\\sqrt2", "-7", "90^\\circ", "12 cm", "\\left(1,2\\right)", ".5", "infinity", "the final answer is 3", "$7$", "2\\text{ cm}"]
_NORMAL = ["42", "1000", "\\frac{1}{2}", "\\df\\frac{3}{4}", "1/2", "0.5", "x=5", "5.00", "red", "10\\%", "\\sqrt{2}", "-7", "90", "12", "<(1,2\\right)", ".5", "infinity", "3", "7", "2"]


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy((F.col("l_partkey") % len(_ANSWERS)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    return lines.withColumn("answer", F.get(F.array(*[F.lit(a) for a in _ANSWERS]), F.col("k")))


def _literals(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@query(f"select k, count(*) as rows, any_value(({_literals(_NORMAL)})[k + 1]) as normal from (select (l_partkey % {len(_ANSWERS)})::int as k from lineitem) group by k")
def normalize_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The expected forms are written out: the rules, applied by hand, are the oracle."""
    return _answers(spark, folder).select("k", "rows", answers.normal_form(F.col("answer")).alias("normal"))


_STRIPPED = ["42", "1,000", "\\frac{1}{2}", "\\frac{3}{4}", "\\frac{1}{2}", "\\frac{1}{2}", "5", "5", "{red}", "10", "\\sqrt{2}", "-7", "90", "12cm", "(1,2)", "\\frac{1}{2}", "\\infty", "thefinalansweris3", "7", "2"]


@query(f"select k, count(*) as rows, any_value(({_literals(_STRIPPED)})[k + 1]) as stripped from (select (l_partkey % {len(_ANSWERS)})::int as k from lineitem) group by k")
def strip_answer(spark: SparkSession, folder: str) -> DataFrame:
    """As normalize_answer, for the other form."""
    return _answers(spark, folder).select("k", "rows", answers.stripped_form(F.col("answer")).alias("stripped"))


@query("""select doc_id from (select doc_id, substr(text, i::bigint, 100) as part from documents, unnest(range(1, length(text) - 98)) as r(i) where length(text) >= 300)
group by doc_id, part having count(*) >= 3""".replace("select doc_id from", "select distinct doc_id from"))
def detect_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(udfs.repeats(F.col("text"))).select("doc_id").distinct()
