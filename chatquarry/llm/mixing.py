"""Mixing sources to target weights: a splitting tree of multivariate hypergeometric draws deals source blocks to shards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import NON_SPACE, Scratch, bounded, in_arrow, table

#: Words of a block, and of an output shard, on average.
BLOCK_WORDS, SHARD_WORDS = 50_000, 1_000_000
#: Sources whose sizes go to the driver, at most; more are an error.
MOST_SOURCES = 1_000_000
#: Ranges of the blocks' permuted order in which a source's blocks are ranked, each by itself: 2 ** RANGE_BITS.
RANGE_BITS = 9
#: What mix_plan() adds to a document.
PLANNED = ("size", "source_size", "target", "taken", "shards", "orders")


def fill(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Targets that share `total` by weight, none above `most` times its size, the excess reshared by weight."""
    caps = sizes * most
    target, open_ = np.zeros(len(sizes)), (sizes > 0) & (weights > 0)
    left = min(float(total), float(caps[open_].sum()))
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > caps)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return target


def leaf(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each source that one shard receives: first position and number, in the source's permuted order.

    The tree halves the shards; at each node a multivariate hypergeometric draw, seeded by the node, says how many of
    each source's blocks go left, the left side's share of all blocks being exact. Each shard walks its own path from
    the root, so any executor can compute any leaf.
    """
    counts, start = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    low, high = 0, shards
    while high - low > 1 and counts.sum():
        middle = (low + high) // 2
        total = int(counts.sum())
        take = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left, rest, need = np.zeros_like(counts), total, take
        for s in np.flatnonzero(counts):  # marginal by marginal; numpy's own is limited to 10**9 in all
            rest -= int(counts[s])
            got = _hypergeometric(rng, int(counts[s]), rest, need)
            left[s], need = got, need - got
        if shard < middle:
            counts, high = left, middle
        else:
            start, counts, low = start + left, counts - left, middle
    return start, counts


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` are good: numpy's draw, and beyond its limit of 10**9 by the distribution function.

    Probabilities follow from the mode's by their ratios, over 12 standard deviations on either side; what lies beyond
    has less weight than a double resolves.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    mode = (draws + 1) * (good + 1) // (n + 2)
    reach = 50 + int(12 * (draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))) ** 0.5)
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(total, rng.random() * total[-1], "right"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE)), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """The mix as one row per document: id_col, size, source_size, target, taken, shards array<int>, and with `carry`
    the struct `carried` of these columns.

    size is the number of words (runs of anything but white space; null: 0). Sources in order of code points, null
    last, have `weights`, repeating; they share `share` of all words, but none gets more than `most` times its own.
    taken is size times the number of shards entries: the document's place in each pass over its source. orders has
    the key of each of these by which a shard's rows are sorted, so sorting by it shuffles each shard locally.

    A source with target r * size is taken floor(r) times whole, then by the remainder: its documents lie in blocks
    by the hash of their id, the blocks in permuted order are taken until the next would go beyond the remainder, and
    of that one documents in permuted order, as long as they fit or come nearer to the target. The blocks of all
    sources and passes are dealt to shards by leaf(). The choice follows from ids, sizes and seed alone, so reruns
    agree. Rows that repeat an id are taken together; a null id is an id. Empty and null texts have size 0 and go with
    their block, very long ones with theirs. An empty table gives an empty result; other columns are ignored, whatever
    their names. A source's table has a row per source and goes to the driver (more than MOST_SOURCES are an error);
    blocks stay on the executors, and the documents of one block with words, some block_words at most, meet in a task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    rows = scratch.keep(rows, "sizes", wide=True)
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = np.array([r.source_size for r in found], np.float64)
    weight = np.array([weights[k % len(weights)] for k in range(len(found))], np.float64)
    target = fill(sizes, weight, share * sizes.sum(), most) if len(found) else sizes
    ratio = np.divide(target, sizes, out=np.zeros(len(found)), where=sizes > 0)
    whole = np.floor(ratio + 1e-9).astype(int)
    n_blocks = np.maximum(np.ceil(sizes / block_words), 1).astype(int)
    kind = "s int, source string, source_size long, target double, whole int, part double, n_blocks int"
    sources = spark.createDataFrame([(k, r.source, int(r.source_size), float(target[k]), int(whole[k]), float(max(0.0, target[k] - whole[k] * sizes[k])), int(n_blocks[k])) for k, r in enumerate(found)], kind)
    about = bounded(sources, 100_000)
    rows = rows.join(about, rows.source.eqNullSafe(sources.source)).select("id", "size", "s", "source_size", "target", "whole", "part", "n_blocks")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("n_blocks")).cast("int"))
    blocks = rows.groupBy("s", "block", "whole", "part").agg(F.sum("size").alias("w"))
    blocks = blocks.withColumn("order", F.xxhash64(F.lit(seed + 1), "s", "block"))
    blocks = scratch.keep(blocks, "blocks")
    blocks = _running(blocks, scratch)
    edge = blocks.where("before < part and before + w > part").select("s", "block", (F.col("part") - F.col("before")).alias("room"))
    # of the block at the edge of a source, each document in permuted order that still fits; those without words always do
    inside = rows.join(bounded(edge), ["s", "block"]).groupBy("s", "block", "room", "id").agg(F.sum("size").alias("size"))
    inside = scratch.keep(inside, "edge")
    order = F.xxhash64(F.lit(seed + 2), "id")
    sized = inside.where("size > 0").select("s", "block", "room", order.alias("h"), "size", "id")
    picked = sized.groupBy("s", "block").applyInArrow(_fitting, sized.select("s", "block", "id").schema)
    picked = scratch.keep(picked.unionByName(inside.where("size = 0").select("s", "block", "id")), "picked")
    # positions of the blocks of each pass in the source's permuted order
    entire = F.col("part") >= F.col("before") + F.col("w")
    at_edge = (F.col("before") < F.col("part")) & ~entire
    passes = blocks.withColumn("passes", F.col("whole") + F.when((entire | at_edge) & (F.col("part") > 0), 1).otherwise(0)).where("passes > 0")
    each = passes.select("s", "block", "rank", "n", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    each = scratch.keep(each.select("s", "block", "pass", (F.col("pass") * F.col("n") + F.col("rank")).alias("position")), "passes")
    counts = np.zeros(len(found), np.int64)
    for r in each.groupBy("s").agg(F.count(F.lit(1)).alias("times")).collect():
        counts[r.s] = r.times
    shards = max(1, int(round(float(target.sum()) / shard_words)))
    dealt = in_arrow(spark.range(0, shards, 1, max(1, min(shards // 64 + 1, 2000))), _leaves(counts, shards, seed), "s int, shard int, first long, n long")
    dealt = dealt.select("s", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("position"))
    each = each.join(dealt, ["s", "position"]).groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("at"))
    each = each.join(blocks.select("s", "block", at_edge.alias("cut")), ["s", "block"])
    each = scratch.keep(each, "dealt")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.struct(*[F.col(c) for c in carry]).alias("carried")) if carry else rows.withColumn("carried", F.lit(None).cast("int"))
    if carry:
        rows = rows.join(about, rows.source.eqNullSafe(sources.source)).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("n_blocks")).cast("int"))
    rows = rows.select("id", "size", "s", "source_size", "target", "whole", "block", "carried").join(bounded(each), ["s", "block"], "left")
    edge_ids = bounded(picked.select(F.col("s").alias("ps"), F.col("block").alias("pb"), F.col("id").alias("pid"), F.lit(True).alias("hit")))
    rows = rows.join(edge_ids, (F.col("s") == F.col("ps")) & (F.col("block") == F.col("pb")) & F.col("id").eqNullSafe(F.col("pid")), "left")
    mine = F.filter(F.coalesce("at", F.array().cast("array<struct<pass:int,shard:int>>")), lambda x: (x["pass"] < F.col("whole")) | ~F.col("cut") | F.col("hit").isNotNull())
    order = lambda x: F.xxhash64(F.lit(seed + 3), x["shard"], x["pass"], "id")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size(mine)).alias("taken"), F.transform(mine, lambda x: x["shard"]).alias("shards"), F.transform(mine, order).alias("orders"), *(["carried"] if carry else []))


def _fitting(group: pa.Table) -> pa.Table:
    """Of one block's documents, in permuted order, those that fit into its room, then one that brings it nearer."""
    group = group.sort_by([("h", "ascending"), ("size", "ascending")])
    size, room = group.column("size").to_numpy(), group.column("room")[0].as_py()
    taken = np.zeros(len(size), bool)
    for k, n in enumerate(size):
        if n <= room:
            taken[k], room = True, room - n
    off = np.where(taken, np.inf, np.abs(size - room))
    if len(off) and off.min() < room:
        taken[int(np.argmin(off))] = True
    return group.filter(pa.array(taken)).select(["s", "block", "id"])


def _running(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds to each block its rank in the source's permuted order, the words before it, and the source's number of blocks.

    Blocks are ranked within ranges of the order, which begin after those before them: no task has all of a source.
    """
    from pyspark.sql import Window as W

    ranged = blocks.withColumn("part_of", F.shiftright("order", 64 - RANGE_BITS))
    sums = ranged.groupBy("s", "part_of").agg(F.sum("w").alias("pw"), F.count(F.lit(1)).alias("pn"))
    over = W.partitionBy("s").orderBy("part_of").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("s", "part_of", F.coalesce(F.sum("pw").over(over), F.lit(0)).alias("words_before"), F.coalesce(F.sum("pn").over(over), F.lit(0)).alias("blocks_before"), F.sum("pn").over(W.partitionBy("s")).alias("n"))
    by = W.partitionBy("s", "part_of").orderBy("order", "block")
    out = ranged.withColumns({"rank": F.row_number().over(by) - 1, "before": F.coalesce(F.sum("w").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}).join(sums, ["s", "part_of"])
    out = out.withColumns({"rank": F.col("rank") + F.col("blocks_before"), "before": F.col("before") + F.col("words_before")})
    return scratch.keep(out.drop("part_of", "words_before", "blocks_before"), "ranked")


def _leaves(counts: np.ndarray, shards: int, seed: int):
    schema = pa.schema([("s", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, n = leaf(counts, shards, shard, seed)
                s = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(np.full(len(s), shard, np.int32)), pa.array(first[s]), pa.array(n[s])], schema=schema)

    return run


def mix(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mixed documents: a row for each time one is taken, with its shard, in shuffled order within each shard.

    Columns of docs, and `shard` in place of one of that name; the files written from it have one shard or several, whole.
    Nulls, empty and repeated rows and empty tables are as in mix_plan().
    """
    plan = mix_plan(docs, seed=seed, carry=docs.columns, **options)
    out = plan.select("carried", F.explode(F.arrays_zip("shards", "orders")).alias("at")).select("carried", F.col("at.shards").alias("shard"), F.col("at.orders").alias("order"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(parts, "shard").sortWithinPartitions("shard", "order")
    return out.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c.lower() != "shard"], "shard")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, a row each: the columns of docs, and what mix_plan() says of them.

    A column of docs that has the name of one of these is `<name>_of_document`. Rows as in mix_plan().
    """
    plan = mix_plan(docs, carry=docs.columns, **options).where(F.size("shards") > 0)
    name = lambda c: f"{c}_of_document" if c.lower() in PLANNED else c
    return plan.select(*[F.col(f"carried.`{c}`").alias(name(c)) for c in docs.columns], *PLANNED)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))
