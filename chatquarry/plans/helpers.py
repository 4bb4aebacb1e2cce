"""Queries of what is settled on the driver: sizes, settings, markers, documents, reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chat
from ..operators import curate, layers, normalize
from ..sources import sinks
from . import settings, summaries
from .registry import query
from .scoring import WITH, scored
from .views import scratch, table

_TABLES = ("documents", "embeddings", "conversations", "lineitem")


def _sizes(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    return [(n, table(spark, folder, n).count()) for n in _TABLES]


_SIZES = " union all ".join(f"select '{n}' as name, count(*)::bigint as n from {n}" for n in _TABLES)


@query(f"select name, greatest(1, round_even(0.03 * ceil(n / 32) * 2, 0))::bigint as steps from ({_SIZES})")
def warmup(spark: SparkSession, folder: str) -> DataFrame:
    """Warm-up steps of a run over each table."""
    return spark.createDataFrame([(n, settings.warmup_steps(rows, 32, 2)) for n, rows in _sizes(spark, folder)], "name string, steps long")


@query(f"select name, n + 500 as by_train, 50000::bigint as by_default, n as by_samples from ({_SIZES})")
def sample_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to draw where the size of the training set, nothing, or the number of samples is given; both are an error."""
    rows = [(n, curate.resolve_sizes(None, rows, 500), curate.resolve_sizes(None, None, 500), curate.resolve_sizes(rows, None, 500)) for n, rows in _sizes(spark, folder)]
    try:
        curate.resolve_sizes(1, 1, 500)
    except ValueError:
        return spark.createDataFrame(rows, "name string, by_train long, by_default long, by_samples long")
    raise AssertionError("two sizes were taken")


@query("select lang, count(*) as pool, 1000 > 5 * count(*) as small from documents group by 1")
def small_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Pools by language that a target of 1,000 rows repeats more than five times."""
    pools = table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("pool"))
    rows = [(r.lang, r.pool, curate.small_pool(r.pool, 1000)) for r in pools.collect()]  # a row a language
    return spark.createDataFrame(rows, "lang string, pool long, small boolean")


_LAYERS = """v_set as (select event_id, event_type, user_id, case event_id % 6 when 0 then '{broken' when 1 then replace(props, '"k"', '"top_k"') when 2 then '{"temperature": ' || (value / 100)::varchar || ', "top_p": "high"}'
    when 3 then '[1, 2]' when 4 then '{"temperature": null, "top_k": 7}' end as file,
  case user_id % 4 when 0 then '{"top_p": 0.5, "new_tokens": 9}' when 1 then '{}' when 3 then '{"temperature": 0.7, "model_len": 8000, "new_tokens": 9000}' end as given from events),
v_json as (select *, case when json_valid(file) and json_type(file) = 'OBJECT' then file::json end as f, given::json as g from v_set)"""


def _layers(spark: SparkSession, folder: str) -> DataFrame:
    """Settings for each event: what the caller gives, and a file's text, which may be malformed, no object or absent."""
    of, props = F.col("event_id") % 6, F.replace("props", F.lit('"k"'), F.lit('"top_k"'))
    warm = F.concat(F.lit('{"temperature": '), (F.col("value") / 100).cast("string"), F.lit(', "top_p": "high"}'))
    file = F.when(of == 0, F.lit("{broken")).when(of == 1, props).when(of == 2, warm).when(of == 3, F.lit("[1, 2]")).when(of == 4, F.lit('{"temperature": null, "top_k": 7}'))
    of = F.col("user_id") % 4
    given = F.when(of == 0, F.lit('{"top_p": 0.5, "new_tokens": 9}')).when(of == 1, F.lit("{}")).when(of == 3, F.lit('{"temperature": 0.7, "model_len": 8000, "new_tokens": 9000}'))
    return table(spark, folder, "events").select("event_id", "event_type", "user_id", file.alias("file"), given.alias("given"))


def _from(field: str, kind: str, fallback: str) -> str:
    of = lambda x: f"try_cast({x} ->> '{field}' as {kind})"
    return f"coalesce({of('g')}, {of('f')}, {fallback})::{kind} as {field}, case when {of('g')} is not null then 'given' when {of('f')} is not null then 'file' else 'fallback' end as {field}_from"


@query(f"""with {_LAYERS} select event_id, {_from("temperature", "double", "0.3")}, {_from("top_p", "double", "0.95")}, {_from("top_k", "int", "20")}, case when file is not null and f is null then 'file' else '' end as malformed from v_json""")
def resolved_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Sampling settings of every event's row from the caller, a file's JSON, or the fallback, with where each is from."""
    fields = {"temperature": ("double", settings.FALLBACK["temperature"]), "top_p": ("double", settings.FALLBACK["top_p"]), "top_k": ("int", settings.FALLBACK["top_k"])}
    out = layers.resolve(_layers(spark, folder), {"given": F.col("given"), "file": F.col("file")}, fields)
    return out.withColumn("malformed", F.array_join("malformed", ",")).drop("event_type", "user_id", "file", "given")


@query(f"""with {_LAYERS}, c as (select event_id, coalesce((g ->> 'model_len')::int, case when event_type = 'click' then 20480 else 4096 end) as model_len, coalesce((g ->> 'new_tokens')::int, case when event_type = 'click' then 16384 else 4096 end) as new_tokens from v_json)
select event_id, model_len, new_tokens, array_to_string(list_filter([case when new_tokens > 4096 then 'the scorer''s cap' end, case when new_tokens > model_len then 'the trained length' end], lambda x: x is not null), ', ') as over,
  model_len > 16384 as refused from c""")
def context_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Context caps of a mode, each overridden by the caller alone; budgets beyond limits; contexts beyond what is supported."""
    rows = layers.resolve(_layers(spark, folder), {"given": F.col("given")}, {"model_len": ("int", None), "new_tokens": ("int", None)})
    mode = F.when(F.col("event_type") == "click", F.lit("legacy")).otherwise(F.lit("strict"))
    rows = rows.select("event_id", layers.context_caps(settings.CAPS, mode, F.col("model_len"), F.col("new_tokens")).alias("c")).select("event_id", "c.*")
    over = layers.beyond(F.col("new_tokens"), {"the scorer's cap": F.lit(4096), "the trained length": F.col("model_len")})
    return rows.select("event_id", "model_len", "new_tokens", F.array_join(over, ", ").alias("over"), (F.size(layers.beyond(F.col("model_len"), {"supported": F.lit(16384)})) > 0).alias("refused"))


@query("""with s as (select source as name, (count(*) % 3)::varchar as r, count(distinct lang)::varchar as alpha, max(n_chars % 5)::varchar as dropout, list_distinct(list(lang || n_chars % 4)) as modules from documents group by source),
b as (select arg_min({'r': r, 'alpha': alpha, 'dropout': dropout, 'modules': modules}, name) as b from s),
d as (select name, unnest([{'field': 'r', 'a': [b.r], 'h': [s.r]}, {'field': 'alpha', 'a': [b.alpha], 'h': [s.alpha]}, {'field': 'dropout', 'a': [b.dropout], 'h': [s.dropout]}, {'field': 'modules', 'a': b.modules, 'h': s.modules}]) as x from s, b)
select name, x.field as field, array_to_string(list_sort(list_filter(x.a, lambda v: not list_contains(x.h, v))), ',') as only_first, array_to_string(list_sort(list_filter(x.h, lambda v: not list_contains(x.a, v))), ',') as only_here
from d where len(list_filter(x.a, lambda v: not list_contains(x.h, v))) + len(list_filter(x.h, lambda v: not list_contains(x.a, v))) > 0""")
def agreeing_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings that follow from each source's documents, against those of the first source: fields, and sets both ways."""
    docs = table(spark, folder, "documents").withColumn("module", F.concat("lang", (F.col("n_chars") % 4).cast("string")))
    groups = docs.groupBy(F.col("source").alias("name")).agg((F.count(F.lit(1)) % 3).alias("r"), F.countDistinct("lang").alias("alpha"), F.max(F.col("n_chars") % 5).alias("dropout"), F.collect_set("module").alias("modules"))
    out = layers.disagreements(groups, "name", ["r", "alpha", "dropout"], ["modules"])
    return out.select("name", "field", F.array_join("only_first", ",").alias("only_first"), F.array_join("only_here", ",").alias("only_here"))


_SHARE = "l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey)"


@query(f"select l_orderkey as order_id, round(sum(w), 6) as total from (select l_orderkey, {_SHARE} * case when l_orderkey % 10 = 0 then 0.9 when l_orderkey % 10 = 1 then 1 + 1e-9 else 1 end as w from lineitem) group by 1 having abs(sum(w) - 1) > 1e-6")
def unbalanced_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Lines' shares of their order as weights, some off: the orders whose weights don't sum to one."""
    share = F.col("l_extendedprice") / F.sum("l_extendedprice").over(W.partitionBy("l_orderkey"))
    of = F.col("l_orderkey") % 10
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"), (share * F.when(of == 0, 0.9).when(of == 1, 1 + 1e-9).otherwise(1.0)).alias("w"))
    return layers.unbalanced(rows, "order_id", "w").withColumn("total", F.round("total", 6))


@query("select lang as name, count(*) as n_problems, true as wrote, false as wrote_again, true as forced from documents group by 1")
def completed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A summary for each language, written unless its marker is there: once, not again, then by force; read back."""
    root = scratch(spark, "runs")
    counts = table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language

    def write(name: str, n: int, force: bool = False) -> bool:
        target = f"{root}/{name}"
        if sinks.marked(spark, target) and not force:
            return False
        sinks.document(spark, {"name": name, "n_problems": n}, f"{target}/summary.json")
        sinks.mark(spark, target)
        return True

    told = {r.lang: (write(r.lang, r.n), write(r.lang, r.n), write(r.lang, r.n, True)) for r in counts}
    found = [sinks.document_at(spark, f"{root}/{name}/summary.json") for name in told]
    rows = [(s["name"], s["n_problems"], *told[s["name"]]) for s in found]
    return spark.createDataFrame(rows, "name string, n_problems long, wrote boolean, wrote_again boolean, forced boolean")


@query("select lang as name, count(*) as rows, count(quality) as rated from documents left join labels using (doc_id) group by 1")
def json_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines keep nulls as nulls: what is written has every field, and comes back as it was."""
    path = scratch(spark, "nulls")
    docs = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    sinks.json_lines(docs, path)
    whole = spark.read.text(path).where(F.col("value").contains('"quality":'))
    back = whole.select(F.from_json("value", "doc_id long, lang string, quality int").alias("r")).select("r.*")
    return back.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.count("quality").alias("rated"))


@query(f"""{WITH}, s as (select subject, count(*) as p, sum(n)::bigint as n, avg(c / n) as rate from v_prob group by 1)
select subject, printf('%s: n_problems=%d n_completions=%d pass_at_1=%.4f', subject, p, n, round(rate, 9)) as line, 'eval-20240102-030405' as run from s""")
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A report's line for each subject, and a run's name."""
    by = scored(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("p"), F.sum("n").alias("n"), F.round(F.avg(F.col("c") / F.col("n")), 9).alias("rate"))
    run = summaries.run_name("eval", datetime(2024, 1, 2, 3, 4, 5))
    rows = [(r.subject, summaries.line(r.subject, {"n_problems": r.p, "n_completions": r.n, "pass_at_1": r.rate}), run) for r in by.collect()]  # a row a subject
    return spark.createDataFrame(rows, "subject string, line string, run string")


@query("select item_id, md5('<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10)) as prompt_md5 from benchmark")
def templated_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered prompts, asserted to be templated; bare ones are refused."""
    rows = table(spark, folder, "benchmark").select("item_id", "text", chat.generation_prompt(F.col("text")).alias("prompt"))
    normalize.assert_templated(rows, "prompt", "item_id")
    try:
        normalize.assert_templated(rows, "text", "item_id")
    except ValueError:
        return rows.select("item_id", F.md5("prompt").alias("prompt_md5"))
    raise AssertionError("a bare prompt was taken for a templated one")
