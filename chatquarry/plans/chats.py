"""Queries of chat messages: validation, schemas, rendering, choices and direct answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, chat, differ
from ..operators import normalize
from .registry import query
from .views import CHATS, chats, table

WITH = f"with {CHATS.strip()}"
_VALID = "len(m) >= 2 and m[1].role = 'user' and m[2].role = 'assistant' and trim(m[1].content) <> '' and conv_id % 2 = 0"


@query(f"{WITH} select conv_id, md5(m[1].content) as prompt_md5, conv_id::varchar as gold from v_chat where {_VALID}")
def chat_pool_validate(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.pool(chats(spark, folder)).select("conv_id", F.md5("prompt").alias("prompt_md5"), "gold")


@query(f"{WITH} select 'indist_' || (row_number() over (order by conv_id) - 1) as problem_id, md5(m[1].content) as problem_md5, conv_id::varchar as gold_answer from v_chat where {_VALID}")
def chat_problem_ids(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.readers import chat_problems

    return chat_problems(chats(spark, folder), "conv_id").select("problem_id", F.md5("problem").alias("problem_md5"), "gold_answer")


@query(f"""{WITH} select conv_id as id, md5(m[1].content) as prompt_md5, conv_id::varchar as answer from v_chat where {_VALID}
union all select item_id, md5(text), 'item' from benchmark""")
def input_schema_union(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of both input schemas in one table: messages, or prompt and answer."""
    a = chats(spark, folder).where(chat.prompt_and_gold(F.col("messages")).isNotNull()).select(F.col("conv_id").alias("id"), "messages", F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("answer"))
    b = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"), F.col("text").alias("prompt"), F.lit("item").alias("answer"))
    return normalize.either_schema(a.unionByName(b), ["id"]).select("id", F.md5("prompt").alias("prompt_md5"), "answer")


_TURN = "case when role in ('user', 'system', 'assistant') then '<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10) else '' end"


@query(f"with {CHATS.strip().split(',' + chr(10) + 'v_chat')[0]} select conv_id, sum(length({_TURN}))::bigint as chars, md5(string_agg({_TURN}, '' order by turn)) as text_md5 from v_msg group by 1")
def chat_render(spark: SparkSession, folder: str) -> DataFrame:
    text = chat.render(F.col("messages"))
    return chats(spark, folder).select("conv_id", text.alias("t")).select("conv_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))


@query("""select item_id, md5('<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10)) as prompt_md5, 0.5::double as solve_rate from benchmark""")
def render_generation_prompt(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark").select("item_id", chat.generation_prompt(F.col("text")).alias("prompt"), F.col("item_id").alias("answer"), F.lit(0.5).alias("solve_rate"))
    return normalize.reward_prompts(rows).select(F.col("answer").alias("item_id"), F.md5("prompt").alias("prompt_md5"), "solve_rate")


@query(r"""with t as (select conv_id, turn, upper(trim(case conv_id % 3 when 0 then ' (b) ' when 1 then text || ' c' else 'i think d' end)) as t from conversations where role = 'assistant'),
w as (select *, regexp_extract_all(regexp_replace(t, '([^\pL\pM\pN_])', '\1\1', 'g'), '(?:^|[^\pL\pM\pN_])([A-Z])(?:$|[^\pL\pM\pN_])', 1) as alone from t)
select conv_id, turn, case when regexp_full_match(t, '\(?[A-Z]\)?[.)]?') then regexp_extract(t, '([A-Z])', 1) when len(alone) = 1 then alone[1] end as label from w""")
def choice_label(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all assistant texts, those with letters of their own included."""
    return _choices(table(spark, folder, "conversations").where("role = 'assistant'"))


def _choices(c: DataFrame) -> DataFrame:
    text = F.when(F.col("conv_id") % 3 == 0, F.lit(" (b) ")).when(F.col("conv_id") % 3 == 1, F.concat("text", F.lit(" c"))).otherwise(F.lit("i think d"))
    return c.select("conv_id", "turn", answers.choice_label(text).alias("label"))


@query("""select conv_id, turn, text is not null and conv_id % 4 <> 3 as same, md5(trim(text)) as key_md5 from conversations where role = 'user'""")
def direct_answer_match(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with a preamble, in another case, quoted, or with a word too many, against lists of aliases."""
    return _direct(table(spark, folder, "conversations").where("role = 'user'"))


def _direct(c: DataFrame) -> DataFrame:
    form = F.col("conv_id") % 4
    said = F.when(form == 0, F.concat(F.lit("The final answer is: "), "text")).when(form == 1, F.upper("text")).when(form == 2, F.concat(F.lit("  «".replace("«", "'")), "text", F.lit("!' "))).otherwise(F.concat(F.lit("Not "), "text"))
    gold = F.to_json(F.array(F.lit("another"), F.col("text")))
    return c.select("conv_id", "turn", answers.correct(answers.extract(said, "knowledge", gold), gold, "knowledge").alias("same"), F.md5(F.trim("text")).alias("key_md5"))


_RENDERED = f"""{CHATS.strip().split(',' + chr(10) + 'v_chat')[0]}, v_text as (select conv_id, string_agg({_TURN}, '' order by turn) as a from v_msg group by 1),
v_two as (select conv_id, a, (conv_id * 7919) % length(a) as p, case conv_id % 3 when 1 then left(a, ((conv_id * 7919) % length(a))::int) || '¤' || substr(a, (conv_id * 7919) % length(a) + 2) when 2 then left(a, ((conv_id * 7919) % length(a))::int) else a end as b from v_text)"""


@query(f"""with {_RENDERED} select conv_id, p::int as place, case conv_id % 3 when 1 then 'character' else 'length' end as kind,
  md5(substr(a, greatest(p - 40, 0) + 1, least(p, 40) + 80)) as left_md5, md5(substr(b, greatest(p - 40, 0) + 1, least(p, 40) + 80)) as right_md5 from v_two where a <> b""")
def rendering_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations rendered twice, the second time with a character changed in a third and cut short in another."""
    rows = chats(spark, folder).select("conv_id", chat.render(F.col("messages")).alias("a"))
    p = ((F.col("conv_id") * 7919) % F.length("a")).cast("int")
    other = F.when(F.col("conv_id") % 3 == 1, F.concat(F.left("a", p), F.lit("¤"), F.substr("a", p + 2))).when(F.col("conv_id") % 3 == 2, F.left("a", p)).otherwise(F.col("a"))
    out = rows.withColumn("b", other).select("conv_id", differ.first_mismatch(F.col("a"), F.col("b")).alias("m")).where("m is not null")
    return out.select("conv_id", "m.place", "m.kind", F.md5("m.left").alias("left_md5"), F.md5("m.right").alias("right_md5"))
