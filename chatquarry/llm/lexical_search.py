"""Ranked lexical search: an index of compressed postings in shards of documents, read document at a time.

A shard holds some documents in the order of their ids; each of its terms has a list of postings, sorted by document
and written as variable-length numbers. A query's lists are merged by a heap whose head is the next document; the
best documents of a shard are held in a bounded heap ordered by score, then id, and the shards' best are merged.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, bounded, by_key, in_arrow, kind_of, sub_batches, table

#: Postings after which a task closes its shard and begins another, and documents likewise.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 50_000
#: Queries that one task of a shard answers; more queries are more tasks for each shard.
QUERY_BLOCK = 500
#: Weight of a document's length in percent, and the saturation of a term's count: 8 m / 1000 beside the count.
LENGTH_SHARE, SATURATION, SCALE = 75, 8, 1_000_000_000

#: What is no part of a term becomes a space, A-Z become a-z; all bytes beyond ASCII are parts of terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on as groups of seven bits, the lowest first, the highest bit set where more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0).astype(np.uint64)
        out[ends[has] - size[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)) | more
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """The numbers of pack(), as int64 (those from 2^63 on wrap)."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), starts).astype(np.int64)


INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("words", pa.int64()), ("first", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
INDEX_KIND = "shard long, term string, n long, words long, first long, docs binary, counts binary"
#: Shards of one partition, at most.
_SHARDS = 1 << 20


class _Shard:
    """Documents of a task until they become a shard: ids, lengths and postings, in the order in which they came."""

    def __init__(self, number: int):
        self.number, self.ids, self.words, self.known = number, [], [], {}
        self.term, self.count, self.each = [], [], []

    def add(self, ident: int | None, words: int, found: Counter) -> None:
        known = self.known
        self.ids.append(ident)
        self.words.append(words)
        self.term += [known.setdefault(t, len(known)) for t in found]
        self.count += found.values()
        self.each.append(len(found))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row without a term, of the documents' ids and lengths, and one for each term with its postings."""
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort([ids, np.array([i is None for i in self.ids])])  # those without an id come last
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, words, named = ids[order], np.array(self.words, np.int64)[order], sum(i is not None for i in self.ids)
        term, count, doc = np.array(self.term, np.int64), np.array(self.count, np.int64), np.repeat(place, self.each)
        gaps = np.diff(ids[:named].view(np.uint64), prepend=ids[:1].view(np.uint64)) if named else np.zeros(0, np.uint64)
        rows = [(self.number, None, len(ids), int(words.sum()), int(ids[0]) if named else 0, pack(gaps), pack(words))]
        by = np.lexsort([doc, term])
        term, count, doc = term[by], count[by], doc[by]
        edges = np.searchsorted(term, np.arange(len(self.known) + 1))
        gaps = np.diff(doc, prepend=0)
        gaps[edges[:-1]] = doc[edges[:-1]]
        for k, t in enumerate(self.known):
            a, b = edges[k], edges[k + 1]
            rows.append((self.number, t.decode(), b - a, int(count[a:b].sum()), 0, pack(gaps[a:b]), pack(count[a:b])))
            if len(rows) >= 5_000:
                yield self.batch(rows)
                rows = []
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(INDEX), INDEX.types)], schema=INDEX)


def query_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times): the terms of each item and how often they occur.

    Rows that repeat an id and a text count once; an id of several texts has the terms of all of them. Null texts
    have no terms; a null id is an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                found = [Counter(terms(t or "")) for t in batch.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(c) for c in found])
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows)), pa.array([t.decode() for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())], names=["item", "term", "times"])

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    return in_arrow(rows, run, f"item {kind_of(items, item_col)}, term string, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[bytes] | None = None) -> DataFrame:
    """The index of all documents that have a term: shard, term, n, words, first, docs binary, counts binary.

    Without a term a row tells of a shard's documents: how many, their words in all, and packed the steps between
    their ids from `first` on, and their lengths; those without an id come last. With a term it tells in how many of
    them it occurs, how often in all, and packed the steps between their places in the shard, and their counts. With
    `only`, other terms get no rows, but count in the lengths. Ids are integers; rows that repeat an id are documents
    of their own, null and empty texts none. Texts are read whole; a shard is closed by the numbers of its documents
    and postings, whatever a task's rows. The frame must be written as it is, not coalesced: shards are numbered by
    task. An empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * _SHARDS
        shard = _Shard(number)
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    if found := terms(text or ""):
                        shard.add(ident, len(found), Counter(found if only is None else filter(only.__contains__, found)))
                        if len(shard.ids) >= SHARD_DOCS or len(shard.term) >= SHARD_POSTINGS:
                            yield from shard.rows()
                            number += 1
                            shard = _Shard(number)
        if shard.ids:
            yield from shard.rows()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, INDEX_KIND)


def best(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of lists (weight, documents in order, values), documents read in order by a heap.

    Once k documents are held, lists whose largest scores together don't exceed the lowest held leave the heap: a
    document in them alone can't enter. They are only searched for the documents of the others, the strongest first.
    """
    lists = sorted((w * max(v), d, [w * x for x in v]) for w, d, v in lists if w > 0 and d)
    bounds = np.cumsum([x[0] for x in lists], dtype=object).tolist()
    ready, out, low, at = 0, [], 0, [0] * len(lists)
    heads = [(d[0], i) for i, (_, d, _) in enumerate(lists)]
    heapq.heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            _, docs, values = lists[i]
            score += values[at[i]]
            at[i] += 1
            if at[i] < len(docs):
                heapq.heapreplace(heads, (docs[at[i]], i))
            else:
                heapq.heappop(heads)
        for i in range(ready - 1, -1, -1):
            if score + bounds[i] <= low:
                break
            _, docs, values = lists[i]
            p = at[i] = bisect_left(docs, doc, at[i])
            if p < len(docs) and docs[p] == doc:
                score += values[p]
        if len(out) < k:
            heapq.heappush(out, (score, -doc))
        elif score > low:
            heapq.heapreplace(out, (score, -doc))
        if len(out) == k and out[0][0] > low:
            low = out[0][0]
            if ready < len(lists) and bounds[ready] <= low:
                while ready < len(lists) and bounds[ready] <= low:
                    ready += 1
                heads = [h for h in heads if h[1] >= ready]
                heapq.heapify(heads)
    return [(s, -d) for s, d in out if s > 0]


FOUND_KIND = "q long, doc_id long, score long"


def _read(n_docs: int, n_words: int, k: int):
    """Answers the queries of each (shard, block): rows (q, doc_id, score), k for a query at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["shard", "block"]):
            ids, size, asked = None, None, {}
            for row in group.to_pylist():
                docs, counts = unpack(row["docs"]), unpack(row["counts"])
                if row["term"] is None:
                    ids = [*(row["first"] + np.cumsum(docs)).tolist(), *[None] * (len(counts) - len(docs))]
                    size = (100 - LENGTH_SHARE) + (LENGTH_SHARE * counts * n_docs) // n_words
                else:
                    docs = np.cumsum(docs)
                    values = ((SCALE * counts) // (1000 * counts + SATURATION * size[docs])).tolist()
                    docs = docs.tolist()
                    for u in row["users"]:
                        asked.setdefault(u["q"], []).append((u["weight"], docs, values))
            found = [(q, ids[d], s) for q, lists in asked.items() for s, d in best(lists, k)]
            cols = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q", "doc_id", "score"])

    return run


def search(index: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item: item, rank int from 1, doc_id, score; items without a document have no row.

    asked is query_terms(); index is build_index(), written. A term in df of the N documents weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums, over the item's terms with repeats, the weight
    times 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L for n words of L in all. Scores above 0 count, equal ones
    by ascending id, null ids last. Every (shard, block of queries) is one task, whose documents are bounded.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "search")
    asked = scratch.keep(asked, "asked")
    about = index.where("term is null").agg(F.sum("n"), F.sum("words")).first()
    n_docs, n_words = about[0] or 0, about[1] or 1
    queries = scratch.keep(asked.select("item").distinct().select("item", F.monotonically_increasing_id().alias("q")), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    wanted = asked.select("term").distinct()
    held = scratch.keep(index.where("term is not null").join(bounded(wanted), "term"), "held")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = held.groupBy("term").agg(F.sum("n").alias("df")).select("term", weight.cast("long").alias("w"))
    users = asked.join(bounded(weights), "term").join(bounded(queries), asked["item"].eqNullSafe(queries["item"]))
    users = users.select("term", "q", (F.col("w") * F.col("times")).alias("weight"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"))
    users = scratch.keep(users.groupBy("term", "block").agg(F.collect_list(F.struct("q", "weight")).alias("users")), "users")
    each = held.join(bounded(users), "term").select("shard", "block", "term", "first", "docs", "counts", "users")
    none = F.lit(None).cast(users.schema["users"].dataType)
    docs = index.where("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "first", "docs", "counts", none.alias("users"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = each.unionByName(docs).repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", F.asc_nulls_first("term"))
    found = in_arrow(tasks, _read(n_docs, n_words, k), FOUND_KIND)
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(bounded(queries), "q").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: Terms and their bytes up to which an index may be asked to hold them alone; beyond it holds all.
ONLY_TERMS, ONLY_BYTES = 1_000_000, 32 << 20


def _only(asked: DataFrame) -> frozenset[bytes] | None:
    """The terms asked for, if they are few, measured."""
    some = asked.select("term").distinct()
    n, size = some.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    return frozenset(r[0].encode() for r in some.collect()) if n <= ONLY_TERMS and (size or 0) <= ONLY_BYTES else None


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() of `items` (item_id, text) in an index of `docs` (doc_id, text) made for their terms; item_id, rank, doc_id, score.

    Null and empty texts on either side find nothing, an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lexical")
    asked = scratch.keep(query_terms(items), "asked")
    index = scratch.keep(build_index(docs, only=_only(asked)), "index", wide=True)
    return search(index, asked, k).withColumnRenamed("item", "item_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select doc_id, r, ts, len(ts)::bigint as n from (select doc_id, row_number() over () as r, {words} as ts from documents) where len(ts) > 0),
a as (select count(*)::bigint as docs, sum(n)::bigint as words from d),
p as (select r, term, count(*)::bigint as tf from (select r, unnest(ts) as term from d) group by all),
df as (select term, count(*)::bigint as df from p group by term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from df, a),
q as (select item_id, term, count(*)::bigint as times from (select item_id, unnest({words}) as term from (select distinct item_id, text from benchmark)) group by all),
s as (select item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::bigint as score
    from q join w using (term) join p using (term) join d using (r), a group by all),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s join d using (r) where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""


OP11_SQL = _sql()
