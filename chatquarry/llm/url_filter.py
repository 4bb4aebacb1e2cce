"""URL filters by a path-template tree, by DataFrame functions only.

Of every host the paths form a tree of segments. Segments of a variable form, and rare ones among many siblings,
become wildcards; sibling branches whose labelled rates don't differ become one, and so do unlabelled siblings of the
same structure; a template is rejected when the smoothed share of bad ones among its labelled urls is high. Explicit rules come before templates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, bounded, table

#: (verdict, host with its subdomains, beginning of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Levels of the tree in OP5_SQL, which takes what is deeper as one last segment; judge() has no such bound.
DEPTH = 4
#: A segment is a wildcard if it has more siblings than this and less than this share of their urls.
SIBLINGS, SHARE = 20, 0.05
#: z value within which a branch's rate equals its siblings'; weight and value of the prior; purity and labels to reject.
SIMILAR, PRIOR_WEIGHT, PRIOR, REJECT, LEAST = 1.96, 2.0, 0.1, 0.8, 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without :// or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<size, blocks, rule, verdict>, else null; among equally long a block wins."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "block").alias("blocks"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,blocks:boolean,rule:string,verdict:string>")


def segment(s: Column) -> Column:
    """A segment as it enters the tree: {n} for numbers, {x} for hexadecimal ids, {v} for others with digits, else itself."""
    return F.when(s.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.lit("{n}")).when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{x}")).when(s.rlike("[0-9]"), F.lit("{v}")).otherwise(s)


def _first_joined(scratch: Scratch, live: DataFrame, join_unlabelled: bool) -> DataFrame:
    """(row, k) of the rows (row, host, node, rest, n, lab, bad) of which a segment becomes a wildcard: the first such, from 0.

    Nodes are those of the tree without joining; down to the first wildcard of a path that is what they are.
    """
    k, rest = F.col("k"), F.col("rest")
    levels = live.select("row", "host", "node", "rest", "n", "lab", "bad", F.explode(F.sequence(F.lit(0), F.size("rest"))).alias("k"))
    prefix, tail = F.slice("rest", F.lit(1), k), F.slice(rest, k + 2, F.size(rest))
    # a node, and what follows a child, are two hashes each, so that no row carries a path for each of its segments
    hashed = [F.xxhash64(F.lit(seed), "host", "node", prefix).alias(f"h{seed}") for seed in (1, 2)] + [F.xxhash64(F.lit(seed), tail).alias(f"t{seed}") for seed in (1, 2)]
    levels = levels.select("row", "k", *hashed, F.coalesce(F.get(rest, k), F.lit("")).alias("s"), "n", "lab", "bad")
    node = ["h1", "h2"]
    tails = levels.groupBy(*node, "s", "t1", "t2").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")])
    form = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("t1").alias("a"), F.bit_xor("t2").alias("b"))
    kids = scratch.keep(tails.groupBy(*node, "s").agg(F.sum("n").alias("kn"), F.sum("lab").alias("kl"), F.sum("bad").alias("kb"), form.alias("form")), "kids")
    all_ = kids.groupBy(*node).agg(F.count(F.lit(1)).alias("many"), F.sum("kn").alias("an"), F.sum("kl").alias("al"), F.sum("kb").alias("ab"))
    all_ = all_.where((F.col("many") > SIBLINGS) | ((F.col("many") > 1) & (F.col("al") > 0)))  # elsewhere nothing is joined
    rate = (F.col("ab") + 1) / (F.col("al") + 2)
    rare = (F.col("many") > SIBLINGS) & (F.col("kn") < SHARE * F.col("an"))
    alike = (F.col("kl") > 0) & (F.col("kl") < F.col("al")) & (F.abs(F.try_divide(F.col("kb"), F.col("kl")) - rate) <= SIMILAR * F.sqrt(F.try_divide(rate * (1 - rate), F.col("kl"))))
    kids = kids.where("s <> ''").join(bounded(scratch.keep(all_, "nodes")), node).select(*node, "s", "form", (F.col("kl") == 0).alias("bare"), rare.alias("rare"), F.coalesce(alike, F.lit(False)).alias("alike"))
    joined = kids.where(F.col("rare") | F.col("alike")).select(*node, "s")
    if join_unlabelled:
        forms = kids.where("alike").select(*node, "form").distinct()
        joined = joined.unionByName(kids.where("bare").join(bounded(scratch.keep(forms, "forms")), [*node, "form"], "left_semi").select(*node, "s")).distinct()
    return levels.select("row", "k", *node, "s").join(bounded(scratch.keep(joined, "joined")), [*node, "s"], "left_semi").groupBy("row").agg(F.min("k").alias("k"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None, join_unlabelled: bool = True) -> DataFrame:
    """Judges every url: id_col, host, path, rule string, verdict string, template string, purity double.

    rule is the longest fitting rule's host and path, else null; verdict (allow or block) is the rule's, else the
    template's. A branch without labels joins its siblings' wildcard if what follows it is the same set of paths as
    follows one that is labelled and in it, unless join_unlabelled is false. Labels of the tree are bad_col (boolean, null: none), where it is given and set, else the rules'
    verdicts. template and purity are those of the url's branch; a branch without labels has the prior's purity and
    is allowed. The tree goes as deep as the paths of a host differ; all its levels are judged at once, and again only
    what is below a wildcard, so there are as many rounds as a path has wildcards by joining, and one. Null urls and those without :// have empty host and path and no rule; ids may have any type. Each row is judged alone, so
    rows that repeat have equal results; an empty table gives an empty result; other columns are ignored. `rules` is
    a list in the plan, for hundreds of rules at most.
    """
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), (F.col(bad_col) if bad_col else F.lit(None)).cast("boolean").alias("bad"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment)
    rows = rows.withColumn("segs", segments).withColumn("bad", F.coalesce("bad", F.col("found.blocks")))
    scratch = Scratch(pages.sparkSession, "tree")
    row = F.monotonically_increasing_id().alias("row")
    live = rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.count_if("bad").alias("bad"))
    live = scratch.keep(live.select(row, "host", "segs", F.array().cast("array<string>").alias("node"), F.col("segs").alias("rest"), "n", "lab", "bad"), "live")
    leaves = []
    while True:
        first = scratch.keep(_first_joined(scratch, live, join_unlabelled), "joined")
        at = live.join(bounded(first), "row", "left")
        leaves.append(at.where("k is null").select("host", "segs", F.concat("node", "rest").alias("node"), "lab", "bad"))
        if first.isEmpty():
            break
        below = at.where("k is not null").select("host", "segs", F.concat("node", F.slice("rest", F.lit(1), F.col("k")), F.array(F.lit("*"))).alias("node"), F.slice("rest", F.col("k") + 2, F.size("rest")).alias("rest"), "n", "lab", "bad")
        live = scratch.keep(below.select(row, "*"), "live")
    tree = scratch.keep(reduce(DataFrame.unionByName, leaves), "tree")
    templates = tree.groupBy("host", "node").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + PRIOR_WEIGHT * PRIOR) / (F.col("lab") + PRIOR_WEIGHT)
    templates = templates.withColumn("purity", purity).withColumn("reject", (F.col("purity") >= REJECT) & (F.col("lab") >= LEAST))
    text = F.concat(F.lit("/"), F.array_join("node", "/"))
    known = tree.select("host", "segs", "node").join(templates, ["host", "node"]).select("host", "segs", text.alias("template"), "purity", "reject")
    out = rows.join(bounded(known), ["host", "segs"], "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    fits = [f"case when (host = {quote(h)} or ends_with(host, {quote('.' + h)})) and starts_with(path, {quote(p)}) then {{'size': {len(h + p)}, 'blocks': {str(v == 'block').lower()}, 'rule': {quote(h + p)}, 'verdict': {quote(v)}}} end" for v, h, p in RULES]
    seg = lambda x: f"case when regexp_full_match({x}, '[0-9]+(\\.[a-z]+)?') then '{{n}}' when regexp_full_match({x}, '[0-9a-fA-F-]{{8,}}') then '{{x}}' when regexp_matches({x}, '[0-9]') then '{{v}}' else coalesce({x}, '') end"
    names = [f"s{k}" for k in range(DEPTH)]
    tails = [f"array_to_string(list_filter([{', '.join(names[k + 1 :])}]::varchar[], lambda x: x <> ''), '/')" for k in range(DEPTH)]
    sql = f"""
with p as (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
f as (select *, list_max(list_filter([{", ".join(fits)}], lambda x: x is not null)) as found,
    list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p),
r as (select *, found.blocks as bad, {", ".join(f"{seg(f'parts[{k + 1}]')} as s{k}" for k in range(DEPTH - 1))},
    case when len(parts) >= {DEPTH} then '**' else '' end as s{DEPTH - 1} from f),
tree0 as (select host, {", ".join(names)}, count(*) as n, count(bad) as lab, count(*) filter (bad) as bad from r group by all)"""
    for k in range(DEPTH):
        above = ", ".join(["host", *[f"t{j}" for j in range(k)]])
        sql += f""",
kids{k} as (select {above}, s{k}, sum(n) as kn, sum(lab) as kl, sum(bad) as kb, string_agg(distinct {tails[k]}, chr(1) order by {tails[k]}) as form from tree{k} group by {above}, s{k}),
all{k} as (select {above}, count(*) as many, sum(kn) as an, sum(kl) as al, sum(kb) as ab, (sum(kb) + 1)::double / (sum(kl) + 2) as rate from kids{k} group by all),
judged{k} as (select *, coalesce(kl > 0 and kl < al and abs(kb::double / nullif(kl, 0) - rate) <= {SIMILAR} * sqrt(rate * (1 - rate) / nullif(kl, 0)), false) as alike from kids{k} join all{k} using ({above})),
forms{k} as (select distinct {above}, form, true as known from judged{k} where alike and s{k} <> ''),
named{k} as (select {above}, s{k}, case when s{k} = '' then '' when many > {SIBLINGS} and kn < {SHARE} * an or alike or kl = 0 and known then '*' else s{k} end as t{k}
    from judged{k} left join forms{k} using ({above}, form)),
tree{k + 1} as (select * from tree{k} join named{k} using ({above}, s{k}))"""
    ts = ", ".join(f"t{k}" for k in range(DEPTH))
    return f"""{sql},
templates as (select host, {ts}, sum(lab) as lab, (sum(bad) + {PRIOR_WEIGHT * PRIOR})::double / (sum(lab) + {PRIOR_WEIGHT}) as purity from tree{DEPTH} group by all),
known as (select host, {", ".join(names)}, '/' || array_to_string(list_filter([{ts}], lambda x: x <> ''), '/') as template, purity, purity >= {REJECT} and t.lab >= {LEAST} as reject
    from tree{DEPTH} join templates t using (host, {ts}))
select page_id, host, path, found.rule as rule, coalesce(found.verdict, case when reject then 'block' else 'allow' end) as verdict, template, round(purity, 6) as purity
from r left join known using (host, {", ".join(names)})
"""


OP5_SQL = _sql()
