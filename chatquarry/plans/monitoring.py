"""Queries of training logs, checkpoints, vectors, and of the streaming layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, monitor, score, vectors
from .registry import query
from .views import COMPLETIONS, problems, scratch, table

WITH = f"with {COMPLETIONS.strip()}"

_STEP = "row_number() over (partition by user_id order by event_id) - 1"
_LOG = f"with v_log as (select user_id as run, {_STEP} as step, case when event_id % 7 = 0 then null else value / 100 end as value from events)"


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log: run, step, value with gaps."""
    from pyspark.sql import Window as W

    step = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, folder, "events").select(F.col("user_id").alias("run"), step.cast("long").alias("step"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 100).alias("value"))


@query(f"""{_LOG}, m as (select run, step, avg(value) over (partition by run order by step rows between 49 preceding and current row) as mean from v_log where value is not null)
select run, step, round(mean, 9) as rolling_mean, case when mean > 0.5 and step >= 200 then 'error' when mean > 0.5 and step >= 100 then 'warn' else 'ok' end as alert from m""")
def rolling_signal(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.rolling_signal(log(spark, folder), "run").select("run", "step", F.round("rolling_mean", 9).alias("rolling_mean"), "alert")


@query(f"{_LOG} select run, step, round(value, 6) as kl from v_log where step < 100 and value > 0.5")
def kl_spike(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).where(monitor.kl_spike(F.col("step"), F.col("value"))).select("run", "step", F.round("value", 6).alias("kl"))


@query("select o_custkey % 10 as run, 'checkpoint-' || max(o_orderkey) as latest from orders where o_orderkey % 3 <> 0 group by 1")
def latest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Names like checkpoint-17, with others between; suffixes compare as numbers."""
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("tmp-"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("checkpoint-"), F.col("o_orderkey")))
    return monitor.latest_checkpoint(table(spark, folder, "orders").select((F.col("o_custkey") % 10).alias("run"), name.alias("name")), "name", ["run"])


@query("""select label::varchar as name, i - 1 as position, round(sum(0.5 * embedding[i]::double), 4) as value from embeddings, range(1, 65) r(i) group by all""")
def weighted_vector_sum(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings merged by label, in blocks of 16 numbers."""
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("name"), F.lit(0.5).alias("weight"), "embedding")
    out = blocks.weighted_sums(blocks.cut(rows, "embedding", 16), "weight")
    each = F.transform("values", lambda v, i: F.struct((F.col("block") * 16 + i).alias("position"), F.round(v, 4).alias("value")))
    return out.select("name", F.inline(each))


@query("""with v as (select vec_id % 4 as adapter, vec_id // 4 as k, embedding from embeddings)
select (k)::varchar as name, i - 1 as position, round(sum([0.1, 0.2, 0.3, 0.4][adapter + 1] * embedding[i]::double), 6) as value from v, range(1, 65) r(i) group by all having count(*) = 4""")
def merged_adapters(spark: SparkSession, folder: str) -> DataFrame:
    """Four adapters' tensors, every fourth embedding each, merged by weights in blocks; a name that isn't in all four, as the
    last one where their number isn't divisible by four, is left out."""
    rows = table(spark, folder, "embeddings").select((F.col("vec_id") % 4).alias("adapter"), F.floor(F.col("vec_id") / 4).alias("name"), "embedding")
    out = blocks.merge(blocks.cut(rows, "embedding", 24), {"0": 0.1, "1": 0.2, "2": 0.3, "3": 0.4}, size=24, strict=False)
    each = F.transform("values", lambda v, i: F.struct((F.col("block") * 24 + i).alias("position"), F.round(v, 6).alias("value")))
    return out.select("name", F.inline(each))


@query("""with p as (select w.vec_id as row, j - 1 as position, w.embedding[j]::double + 0.5 * sum(w.embedding[a.vec_id + 1]::double * a.embedding[j]::double) as v
  from embeddings w, embeddings a, range(1, 65) r(j) where a.vec_id < 8 group by w.vec_id, j, w.embedding)
select row, position, round(v, 6) as value from p""")
def folded_product(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as a matrix, with half of a product of rank 8 added: their first 8 columns by the first 8 embeddings."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    base, right = blocks.matrix(rows, "vec_id", "embedding", 50, 32), blocks.matrix(rows.where("vec_id < 8"), "vec_id", "embedding", 4, 32)
    left = blocks.matrix(rows.select("vec_id", F.slice("embedding", 1, 8).alias("v")), "vec_id", "v", 50, 4)
    out = blocks.matrix_rows(blocks.fold(base, left, right, 0.5), 50)
    return out.select("row", F.posexplode("values").alias("position", "value")).select("row", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


_KEPT = "('0x' || substr(md5('42|drop|' || vec_id || ':' || i), 1, 15))::bigint % 1000000 >= 300000"


@query(f"""select label, count(*) as rows, sum(zeros)::bigint as zeros, round(sum(total), 4) as total from (select label,
  list_sum(list_transform(range(64), lambda i: (not {_KEPT})::int)) as zeros,
  list_sum(list_transform(range(64), lambda i: case when {_KEPT} then embedding[i + 1]::double / 0.7 else 0 end * (i + 1))) as total from embeddings) group by 1""")
def drop_and_rescale(spark: SparkSession, folder: str) -> DataFrame:
    """What is dropped, and the sums of what stays, rescaled and weighted by position."""
    rows = vectors.drop_and_rescale(table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "v", 0.3)
    weighed = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    zeros = F.size(F.filter("v", lambda x: x == 0))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(zeros).alias("zeros"), F.round(F.sum(weighed), 4).alias("total"))


@query("select doc_id, case when doc_id % 5 = 0 then 'first' else 'second' end as only_in from documents where doc_id % 5 in (0, 1)")
def missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return vectors.missing_keys(docs.where("doc_id % 5 <> 1"), docs.where("doc_id % 5 <> 0"), "doc_id")


@query(f"{WITH} select problem_id, n, c, n_runs from v_prob, (select 2::bigint as n_runs)")
def stream_chunked_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Problems as files of a stream, scored chunk by chunk with a checkpoint; the result is read back.

    Two runs: the second, over the files that came after the first, resumes behind it, so no problem is scored twice.
    A chunk is a quarter of the files that are there, so chunks grow with the input and their number doesn't.
    """
    from ..streaming import incremental, manifest

    root = scratch(spark, "stream")
    rows, first = problems(spark, folder), F.col("problem_id") % 2 == 0
    kind = "problem_id long, gold string, subject string, level string, completions array<string>"
    for some in (first, ~first):
        rows.where(some).write.mode("append").option("maxRecordsPerFile", 20_000).parquet(f"{root}/in")
        stream = incremental.chunks(spark, f"{root}/in", kind, incremental.files_a_batch(spark, f"{root}/in", 4), "parquet")
        incremental.process(stream, lambda b: score.count_correct(b).select("problem_id", F.col("n").cast("long").alias("n"), F.col("c").cast("long").alias("c")), f"{root}/out", f"{root}/state")
    out = manifest.committed(spark, f"{root}/out", "problem_id long, n long, c long")
    runs = out.agg(F.countDistinct(F.col("problem_id") % 2).alias("n_runs"))
    return out.select("problem_id", "n", "c").crossJoin(F.broadcast(runs))  # one row
