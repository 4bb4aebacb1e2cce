"""Queries of curation: caps, deduplication, sampling, splits, mixes, and the whole training-set build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat
from ..functions import text as tx
from ..operators import curate
from .extraction import STAGED, staged
from .registry import query
from .views import table


def rank(key: str, salt: str, seed: int = 42) -> str:
    return f"md5('{seed}|{salt}|' || {key})"


def number(key: str, salt: str, below: str, seed: int = 42) -> str:
    return f"(('0x' || substr({rank(key, salt, seed)}, 1, 15))::bigint % {below})"


_KEY = "replace(replace(replace(replace(replace(lower(text), '\\,', ''), '\\;', ''), '\\!', ''), '\\ ', ''), '$', '')"
_KEY = f"trim(regexp_replace({_KEY}, '[\\x09-\\x0d\\x1c-\\x20]+', ' ', 'g'))"


@query(f"select doc_id, md5(text) as text_md5 from documents qualify row_number() over (partition by text order by {rank('doc_id', 'cap')}, doc_id) <= 4")
def cap_per_query(spark: SparkSession, folder: str) -> DataFrame:
    return curate.cap_per_key(table(spark, folder, "documents").select("doc_id", "text"), "text", 4, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query(f"select doc_id from (select doc_id, {_KEY} as k from documents) where k <> '' qualify row_number() over (partition by k order by doc_id) = 1")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return curate.dedup_first(table(spark, folder, "documents").select("doc_id", "text"), tx.problem_key(F.col("text")), "doc_id").select("doc_id")


@query(f"select doc_id from documents order by {rank('doc_id', 'shuffle')}, doc_id limit 200")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    return curate.take_seeded(table(spark, folder, "documents").select("doc_id"), 200, "doc_id")


@query(f"select doc_id, case when row_number() over (order by {rank('doc_id', 'shuffle')}, doc_id) <= 50 then 'eval' else 'train' end as split from documents")
def train_eval_split(spark: SparkSession, folder: str) -> DataFrame:
    return curate.split_train_eval(table(spark, folder, "documents").select("doc_id"), 50, "doc_id")


def _draws(pool: str, target: int, salt: str) -> str:
    return f"select p.doc_id from range({target}) d(i), (select count(*) as n from {pool}) s join (select doc_id, row_number() over (order by doc_id) - 1 as pos from {pool}) p on p.pos = {number('d.i', salt, 's.n')}"


@query(f"with pool as (select doc_id from documents where lang = 'de') select doc_id, count(*) as times from ({_draws('pool', 500, 'bucket')}) group by 1")
def oversample_bucket(spark: SparkSession, folder: str) -> DataFrame:
    pool = table(spark, folder, "documents").where("lang = 'de'").select("doc_id")
    return curate.oversample(pool, 500, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))


@query(f"""with pool as (select doc_id, lang, quality from documents join labels using (doc_id)), fr as (select doc_id from pool where lang = 'fr'), good as (select doc_id from pool where quality = 1),
mixed as (select 'base' as bucket, doc_id from (select doc_id from documents order by {rank('doc_id', 'shuffle')}, doc_id limit 300)
  union all select 'fr', doc_id from ({_draws('fr', 120, 'fr')}) union all select 'good', doc_id from ({_draws('good', 180, 'good')}))
select bucket, doc_id, count(*) as times from mixed group by all""")
def bucket_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    pool = docs.join(table(spark, folder, "labels"), "doc_id").select("doc_id", "lang", "quality")
    mixed = curate.bucket_mix(docs.withColumn("quality", F.lit(None).cast("int")), 300, [("fr", F.col("lang") == "fr", 120), ("good", F.col("quality") == 1, 180)], pool, "doc_id")
    return mixed.groupBy("bucket", "doc_id").agg(F.count(F.lit(1)).alias("times"))


@query(f"""select * from (select doc_id as id, 'document' as origin from documents order by {rank('doc_id', 'shuffle')}, doc_id limit 62)
union all select * from (select conv_id * 100 + turn as id, 'turn' as origin from conversations order by {rank('(conv_id * 100 + turn)', 'shuffle')}, conv_id * 100 + turn limit 63)""")
def two_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"))
    b = table(spark, folder, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lit("turn").alias("origin"))
    return curate.mix_two(a, b, 125, 0.5, "id")


_STRIP = "trim(reasoning, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""{STAGED}, kept as (select * from v_stage where reason is null qualify row_number() over (partition by query order by {rank('doc_id', 'cap')}, doc_id) <= 4)
select doc_id, case when row_number() over (order by {rank('doc_id', 'shuffle')}, doc_id) <= 50 then 'eval' else 'train' end as split, md5(query) as prompt_md5,
  md5('<think>' || chr(10) || {_STRIP} || chr(10) || '</think>' || chr(10) || chr(10) || '\\boxed{{' || inside || '}}') as response_md5
from kept""")
def sft_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The training-set build as a whole: filters, cap, seeded split, messages."""
    kept = curate.cap_per_key(staged(spark, folder).where("reason is null"), "query", 4, "doc_id")
    out = curate.split_train_eval(kept, 50, "doc_id").withColumn("messages", chat.example(F.col("query"), F.col("reasoning"), F.col("inside")))
    part = lambda k: F.md5(F.get("messages", F.lit(k)).content)
    return out.select("doc_id", "split", part(0).alias("prompt_md5"), part(1).alias("response_md5"))


@query(f"""{STAGED} select doc_id, md5('<think>' || chr(10) || {_STRIP} || chr(10) || '</think>' || chr(10) || chr(10) || '\\boxed{{' || inside || '}}') as response_md5 from v_stage where reason is null""")
def canonical_response(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder).where("reason is null").select("doc_id", F.md5(chat.response(F.col("reasoning"), F.col("inside"))).alias("response_md5"))


@query("select lang, count(*) as rows from (select doc_id, lang from documents except all select doc_id, lang from documents where doc_id % 3 = 0) group by 1")
def bag_difference(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return curate.difference(docs, docs.where("doc_id % 3 = 0")).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
