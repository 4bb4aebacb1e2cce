"""The inputs that the catalogue's queries share, as DataFrames and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.folders import scratch  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, query, response, lang, source: documents with an answer appended in one of eight forms."""
    n = F.col("doc_id").cast("string")
    text, form = F.col("text"), F.col("doc_id") % 8
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    response = (
        F.when(form == 0, cat(text, " The answer is: $\\boxed{", n, "}$"))
        .when(form == 1, cat(text, " \\boxed{\\frac{", n, "}{7}}"))
        .when(form == 2, text)
        .when(form == 3, cat("\\boxed{1} ", text, " \\boxed {", n, "}"))
        .when(form == 4, cat(text, " \\boxed{", n))
        .when(form == 5, cat(text, " \\boxed{\\{x : x > ", n, "\\}}"))
        .when(form == 6, cat(text, " \\fbox{", n, "}"))
        .otherwise(cat(text, " \\boxed{{", n, "}}"))
    )
    return table(spark, folder, "documents").select("doc_id", F.col("text").alias("query"), response.alias("response"), "lang", "source")


RESPONSES = r"""
v_resp as (select doc_id, text as query, lang, source, case doc_id % 8
  when 0 then text || ' The answer is: $\boxed{' || doc_id || '}$' when 1 then text || ' \boxed{\frac{' || doc_id || '}{7}}'
  when 2 then text when 3 then '\boxed{1} ' || text || ' \boxed {' || doc_id || '}' when 4 then text || ' \boxed{' || doc_id
  when 5 then text || ' \boxed{\{x : x > ' || doc_id || '\}}' when 6 then text || ' \fbox{' || doc_id || '}'
  else text || ' \boxed{{' || doc_id || '}}' end as response from documents)"""

#: Balanced braces up to three deep, as a regular expression without back-references.
_IN1 = r"[^{}]*"
_IN2 = rf"{_IN1}(?:\{{{_IN1}\}}{_IN1})*"
_IN3 = rf"{_IN1}(?:\{{{_IN2}\}}{_IN1})*"
#: As above, a backslash hiding the next character.
_E1 = r"(?:[^{}\\]|\\.)*"
_E2 = rf"{_E1}(?:\{{{_E1}\}}{_E1})*"
_E3 = rf"{_E1}(?:\{{{_E2}\}}{_E1})*"


def sql_score_answer(x: str, peel: bool = True) -> str:
    """The scorer's extraction: the last marker's text is matched anchored, so an earlier box is never used."""
    tail = rf"case when contains({x}, '\boxed') then '\boxed' || string_split({x}, '\boxed')[-1] when contains({x}, '\fbox') then '\fbox' || string_split({x}, '\fbox')[-1] end"
    inner = rf"nullif(regexp_extract({tail}, '^\\(?:boxed|fbox)\{{((?s:{_IN3}))\}}', 1) || case when regexp_matches({tail}, '^\\(?:boxed|fbox)\{{(?s:{_IN3})\}}') then '' end, null)"
    return rf"regexp_replace({inner}, '^\{{(.*)\}}$', '\1')" if peel else inner


def sql_split_box(x: str) -> tuple[str, str]:
    """(before, inside) of the last box with optional white space; escapes hide braces."""
    n = rf"len(regexp_extract_all({x}, '\\boxed\s*\{{'))"
    parts = rf"string_split_regex({x}, '\\boxed\s*\{{')"
    inside = rf"case when {n} > 0 and regexp_matches({parts}[-1], '^(?s:{_E3})\}}') then regexp_extract({parts}[-1], '^((?s:{_E3}))\}}', 1) end"
    before = rf"case when {n} > 0 and regexp_matches({parts}[-1], '^(?s:{_E3})\}}') then regexp_extract({x}, '(?s)^(.*)\\boxed\s*\{{', 1) end"
    return before, inside


def sql_level_box(x: str) -> str:
    rest = rf"string_split({x}, '\boxed{{')[-1]"
    return rf"case when contains({x}, '\boxed{{') and regexp_matches({rest}, '^(?s:{_IN3})\}}') then regexp_extract({rest}, '^((?s:{_IN3}))\}}', 1) end"


def sql_strip_preamble(x: str, passes: int = 6) -> str:
    """One delimiter or phrase a pass, from the end, white space before each; the passes are a fold over a list."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    r = f"rtrim(a, {space})"
    cases = [f"when ends_with({r}, '{d}') then left({r}, length({r}) - {len(d)})" for d in ("$$", "$", "\\[", "\\(")]
    for p in ("the answer is:", "the answer is", "final answer:", "answer:"):
        before = f"(length({r}) = {len(p)} or contains({space}, substr({r}, length({r}) - {len(p)}, 1)))"
        cases.append(f"when ends_with(lower({r}), '{p}') and {before} then left({r}, length({r}) - {len(p)})")
    return f"rtrim(list_reduce([{x}{', null' * passes}], lambda a, b: case {' '.join(cases)} else {r} end), {space})"


def completions(spark: SparkSession, folder: str) -> DataFrame:
    """A row per completion: problem_id, completion_idx, completion, gold, subject, level. Orders are problems, all their
    lines completions, so problems differ in the number of completions."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", (F.col("l_quantity").cast("int") % 5).alias("v"))
    ranked = lines.withColumn("k", F.row_number().over(by))
    text = F.concat(F.lit("<think>\nline "), F.col("l_linenumber").cast("string"), F.lit("\n</think>\n\n"), F.when(F.col("l_partkey") % 11 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("\\boxed{"), F.col("v").cast("string"), F.lit("}"))))
    ranked = ranked.select(F.col("l_orderkey").alias("problem_id"), (F.col("k") - 1).alias("completion_idx"), text.alias("completion"), F.col("l_partkey").alias("part"))
    known = orders.select(F.col("o_orderkey").alias("problem_id"), (F.col("o_orderkey") % 5).cast("string").alias("gold"), F.col("o_orderpriority").alias("subject"), F.concat(F.lit("Level "), (F.col("o_custkey") % 5 + 1).cast("string")).alias("level"))
    return ranked.join(known, "problem_id")


COMPLETIONS = r"""
v_comp as (select l_orderkey as problem_id, k - 1 as completion_idx,
    '<think>' || chr(10) || 'line ' || l_linenumber || chr(10) || '</think>' || chr(10) || chr(10) || case when l_partkey % 11 = 0 then 'no answer' else '\boxed{' || v || '}' end as completion,
    case when l_partkey % 11 = 0 then null else v::varchar end as answer, l_partkey as part,
    (l_orderkey % 5)::varchar as gold, o_orderpriority as subject, 'Level ' || (o_custkey % 5 + 1) as level
  from (select *, l_quantity::int % 5 as v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as k from lineitem)
    join orders on l_orderkey = o_orderkey),
v_ok as (select *, coalesce(answer = gold, false) as correct from v_comp),
v_prob as (select problem_id, any_value(subject) as subject, any_value(level) as level, any_value(gold) as gold, count(*)::bigint as n, count(*) filter (correct)::bigint as c from v_ok group by 1)"""


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """A row per problem with its completions in order: problem_id, gold, subject, level, completions."""
    got = completions(spark, folder)
    return got.groupBy("problem_id", "gold", "subject", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("completion_idx", "completion"))), lambda x: x.completion).alias("completions"))


def chats(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, messages: conversations in order of turns, a boxed answer after the assistant's text where conv_id is even."""
    c = table(spark, folder, "conversations")
    content = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), F.concat("text", F.lit(" \\boxed{"), F.col("conv_id").cast("string"), F.lit("}"))).otherwise(F.col("text"))
    got = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", content.alias("content")))).alias("m"))
    return got.select("conv_id", F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages"))


CHATS = r"""
v_msg as (select conv_id, turn, role, case when role = 'assistant' and conv_id % 2 = 0 then text || ' \boxed{' || conv_id || '}' else text end as content from conversations),
v_chat as (select conv_id, list({'role': role, 'content': content} order by turn) as m from v_msg group by conv_id)"""
