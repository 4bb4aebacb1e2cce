"""Similarity join of texts on word shingles: MinHash values compared step by step under a Bayesian bound, then exact Jaccard.

Words are what stands between white space in the lower-cased text; a shingle is `width` words in a row. A text of
fewer words has one shingle, all its words; a text without words, or null, has none and links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ALIVE_KIND, Scratch, alive, block_pairs, bounded, by_key, by_task, components, deal, in_arrow, links_of, narrow, stars, sub_batches, table

#: Bands of the index and MinHash values in each: a pair at Jaccard 0.8 shares no band with probability 3e-5.
BANDS, ROWS = 20, 4
#: MinHash values compared at each step of the Bayesian pruning.
STEP = 16

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at once; a word isn't cut, so one of more bytes than this comes alone.
PART = 1 << 20


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as a part has bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        out = []
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(1 << (n - 1).bit_length(), base, np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
        if n <= 2 * PART:  # those for a longer word are not kept
            self.up, self.down = out
        return out[0], out[1]


_POWERS = _Powers()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of an array of texts: a 64-bit hash of every word, and the number of words of each text."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    at = np.frombuffer(lower.buffers()[1], np.int32, len(lower) + 1, lower.offset * 4).astype(np.int64)
    raw = np.frombuffer(lower.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(lower), np.int64)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    first = np.zeros(len(raw), bool)
    first[at[:-1][at[:-1] < len(raw)]] = True
    begins = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first))
    ends_mask = word & np.concatenate([~word[1:] | first[1:], [True]])
    ends = np.flatnonzero(ends_mask) + 1
    hashes = np.empty(len(begins), np.uint64)
    a = 0
    while a < len(begins):  # a long text in parts that end with a word
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + PART, "right")))
        low, high = int(begins[a]), int(ends[b - 1])
        up, down = _POWERS.to(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        x, y = begins[a:b] - low, ends[a:b] - low
        hashes[a:b] = _mix((total[y] - total[x]) * down[x] + (y - x).astype(np.uint64) * _M2)
        a = b
    return hashes, np.diff(np.searchsorted(begins, at))


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats included) in the order of the texts, and the number for each text."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    rolled = np.zeros(len(words), np.uint64)
    for k in range(width):  # the last shingles of a text run over its end; those aren't taken below
        rolled[: len(words) - k] += _mix(words[k:] + np.uint64(0x1000003 * (k + 1)))
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:
        w = words[starts[i] : starts[i + 1]]
        rolled[starts[i]] = np.sum(_mix(w + np.arange(1, len(w) + 1, dtype=np.uint64) * np.uint64(0x1000003)), dtype=np.uint64) + np.uint64(len(w))
    where = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    return _mix(rolled[where]), n


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20_111).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(values: np.ndarray, counts: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n MinHash values of 32 bits for each text; texts without shingles have zeros."""
    out = np.zeros((len(counts), n), np.uint32)
    full = np.flatnonzero(counts > 0)
    starts = np.concatenate([[0], np.cumsum(counts[full])])
    a = 0
    while a < len(full):  # a part fits the processor's cache
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + 60_000, "right")) - 1)
        part, at = values[starts[a] : starts[b]], starts[a:b] - starts[a]
        for k, factor in enumerate(_factors(n)):
            x = part * factor
            out[full[a:b], k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at)
        a = b
    return out


def text_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words."""
    out = np.zeros((len(counts), 2), np.int64)
    full = np.flatnonzero(counts > 0)
    if len(full):
        starts = (np.concatenate([[0], np.cumsum(counts)])[:-1])[full]
        place = (np.arange(len(words)) - np.repeat(starts, counts[full])).astype(np.uint64)
        for k, salt in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            sums = np.add.reduceat(_mix(words ^ _mix(place * np.uint64(2) + np.uint64(salt))), starts)
            out[full, k] = _mix(sums + counts[full].astype(np.uint64)).view(np.int64)
    return out


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The least number of equal values among n for which P(Jaccard >= threshold) is at least the tolerance.

    The prior is uniform; after m matches of n the posterior is Beta(m + 1, n - m + 1), whose tail above t is
    P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _describe(width: int):
    names = ["id", "exact", "h1", "h2", "n_shingles", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                with np.errstate(over="ignore"):
                    words, counts = word_hashes(batch.column("text"))
                    values, n = shingles(words, counts, width)
                    sig, keys = minhash(values, n), text_keys(words, counts)
                offsets = pa.array(np.arange(len(n) + 1) * sig.shape[1], pa.int32())
                flat = pa.array(sig.view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("exact"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n), pa.ListArray.from_arrays(offsets, flat)], names=names)

    return run, "exact long, h1 long, h2 long, n_shingles long, sig array<int>"


#: Pairs whose values are compared at once.
PAIRS = 100_000


def _candidates(group: pa.Table, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task's rows whose first common band is this one and whose posterior stays over the tolerance at every step."""
    least = {n: least_matches(threshold, tolerance, n) for n in range(STEP, BANDS * ROWS + 1, STEP)}
    i, j, band = group.column("i")[0].as_py(), group.column("j")[0].as_py(), (group.column("key")[0].as_py() >> 54) & 63
    blk = group.column("blk").to_numpy()
    sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(blk), -1)
    if i == j:
        x, y = np.triu_indices(len(blk), 1)
    else:
        x, y = (a.ravel() for a in np.meshgrid(np.flatnonzero(blk == i), np.flatnonzero(blk == j), indexing="ij"))
    out = [(x[:0], y[:0])]
    for a in range(0, len(x), PAIRS):
        u, v = x[a : a + PAIRS], y[a : a + PAIRS]
        for b in [band, *range(band)]:
            part = slice(b * ROWS, (b + 1) * ROWS)
            stay = (sig[u, part] == sig[v, part]).all(axis=1) == (b == band)
            u, v = u[stay], v[stay]
        met = np.zeros(len(u), np.int64)
        for n in range(STEP, BANDS * ROWS + 1, STEP):
            met += (sig[u, n - STEP : n] == sig[v, n - STEP : n]).sum(axis=1)
            stay = met >= least[n]
            u, v, met = u[stay], v[stay], met[stay]
        out.append((u, v))
    return np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])


def _prune(threshold: float, tolerance: float):
    """Of each task the rows that have a candidate there: texts are fetched for these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key", "i", "j"]):
            if group.num_rows > 1:
                x, y = _candidates(group, threshold, tolerance)
                if len(x):
                    yield alive(group, np.unique(np.concatenate([x, y])))

    return run, ALIVE_KIND


def _verify(threshold: float, tolerance: float, width: int):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def exact(x: np.ndarray, y: np.ndarray, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which of the pairs have a Jaccard of the threshold at least; text i has the distinct values edges[i]..edges[i+1]."""
        size = np.diff(edges)
        if len(x) <= 2 * len(size):
            both = np.array([len(np.intersect1d(values[edges[a] : edges[a + 1]], values[edges[b] : edges[b + 1]], assume_unique=True)) for a, b in zip(x, y)], np.int64)
        else:
            names, code, times = np.unique(values, return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(size)), size)
            common = np.full(len(names), -1, np.int64)
            common[times > 1] = np.arange((times > 1).sum())
            code = common[code]
            row, code = row[code >= 0], code[code >= 0]
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            counts = np.zeros((len(size), len(size)), np.float32)  # below 2**24 exact
            for a in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
                lo, hi = np.searchsorted(code, [a, a + 2048])
                m = np.zeros((len(size), 2048), np.float32)
                m[row[lo:hi], code[lo:hi] - a] = 1
                counts += m @ m.T
            both = counts[x, y].astype(np.int64)
        return both >= threshold * (size[x] + size[y] - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key", "i", "j"]):
            if group.num_rows < 2:
                continue
            x, y = _candidates(group, threshold, tolerance)
            if not len(x):
                continue
            used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            x, y = at[: len(x)], at[len(x) :]
            parts = []
            with np.errstate(over="ignore"):
                for text in group.column("text").take(pa.array(used)).chunks:
                    for k in range(len(text)):
                        parts.append(np.unique(shingles(*word_hashes(text.slice(k, 1)), width)[0]))
            edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ok = exact(x, y, np.concatenate(parts), edges)
            if ok.any():
                ids = group.column("id").to_numpy()[used]
                count, root = stars(ids, x[ok], y[ok])
                has = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(count[has]), pa.array(root[has])], schema=schema)

    return run, "id long, links long, root long"


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, tolerance: float = 1e-5) -> DataFrame:
    """Links texts whose sets of shingles have a Jaccard of `threshold` at least.

    Returns one row per input row: id_col, class_id (the smallest id with the same words), n_copies (rows with the
    same words, itself included), n_links (other classes linked directly), component_id (the smallest id reachable
    through links and equal words) and kept (id = component_id).

    Rows with the same words form a class; only class representatives are compared, and a class's links hold for all
    its rows. Candidates come from bands of MinHash values; every candidate pair's values are compared STEP at a time
    and the pair is dropped once the posterior probability of reaching the threshold falls below `tolerance`; the
    rest is verified on the whole texts, which are fetched for these alone. Ids may have any type that has an order.
    Null, empty and blank texts are classes of their own: class_id and component_id are their id, n_copies 1, n_links
    0. A null id takes part through its text: it has its class's and its links' figures, class_id and component_id
    are null where no row of the class, or the component, has an id, and kept is false. Rows that repeat an id share
    a component. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    out = _classified(docs, id_col, text_col, threshold, width, tolerance, True)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return narrow(out).select(F.col("id").alias(id_col), "class_id", "n_copies", "n_links", "component_id", kept)


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, tolerance: float, by_id: bool) -> DataFrame:
    """One row per input row: id, exact (its text's hash), class_id, n_copies, n_links, component_id, best.

    best (nameless, id, exact) is the first of the component's rows: those with an id come before those without, then
    the smallest id, then the smallest hash of a text; it is null for texts without words. With by_id rows that
    repeat an id share a component whatever their texts.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("exact", F.xxhash64("text"))
    run, kind = _describe(width)
    rows = scratch.keep(in_arrow(texts, run, f"id {texts.dtypes[0][1]}, {kind}"), "signatures", wide=True)
    some = rows.where("n_shingles > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "exact")).alias("first")
    classes = some.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("n_copies"), F.min("n_shingles").alias("weight"), F.first("sig").alias("sig"))
    classes = scratch.keep(classes.withColumn("id", F.xxhash64("h1", "h2")), "classes", each=4)
    mask = (1 << 54) - 1
    keys = F.array(*[F.lit(b << 54).bitwiseOR(F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)).bitwiseAND(F.lit(mask))) for b in range(BANDS)])
    met = block_pairs(classes.select("id", "weight", keys.alias("keys")), 512, 500_000)
    signed = classes.select("id", "sig")
    run, kind = _prune(threshold, tolerance)
    near = scratch.keep(in_arrow(deal(met.join(signed, "id"), ["sig"]), run, kind), "candidates", each=4)
    wanted = bounded(near.select("id").distinct().join(classes, "id").select(F.col("id").alias("class"), F.col("first.id").alias("rep"), F.col("first.exact").alias("of")))
    used = texts.join(wanted, (F.col("exact") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep"))).groupBy(F.col("class").alias("id")).agg(F.min("text").alias("text"))
    run, kind = _verify(threshold, tolerance, width)
    found = scratch.keep(links_of(in_arrow(by_task(near.join(signed, "id").join(used, "id")), run, kind)), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if by_id:
        named = some.where("id is not null").select("id", F.xxhash64("h1", "h2").alias("a"))
        several = named.groupBy("id").agg(F.min("a").alias("b"), F.max("a").alias("hi")).where("b <> hi").select("id", "b")
        edges = edges.unionByName(named.join(bounded(several), "id").select("a", "b"))
    group = components(edges, scratch)
    about = classes.drop("sig", "weight").join(links, "id", "left").join(group, classes.id == group.node, "left").withColumn("root", F.coalesce("component", classes.id))
    about = about.join(about.groupBy("root").agg(F.min("first").alias("best")), "root").select("h1", "h2", F.col("first.id").alias("rep"), "n_copies", F.coalesce("links", F.lit(0)).alias("links"), "best")
    out = rows.drop("sig").join(about, ["h1", "h2"], "left")
    either = lambda none, other: F.when(F.col("n_shingles") == 0, none).otherwise(other)
    return out.select(
        "id", "exact", either(F.col("id"), F.col("rep")).alias("class_id"), either(F.lit(1), F.col("n_copies")).cast("long").alias("n_copies"),
        either(F.lit(0), F.col("links")).cast("long").alias("n_links"), either(F.col("id"), F.col("best.id")).alias("component_id"), "best",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """docs without near duplicates: of each group of texts that link, one row stays.

    That is the row with the smallest id, a row without an id only where none of the group has one; among rows of that
    id the one whose text has the smallest hash. Rows equal in id and text are one row afterwards. Rows that share an
    id alone are not a group, so different texts of an id all stay. Texts without words link with nothing and stay, of
    rows equal in id and text one, without an id all. An empty table gives an empty result. Columns are those of docs,
    whatever their names.
    """
    groups = _classified(docs, id_col, text_col, threshold, width, 1e-5, False)
    chosen = F.col("best").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("exact") == F.col("best.exact")))
    stays = groups.where(chosen).groupBy("id", "exact", F.col("best").isNull().alias("wordless")).agg(F.count(F.lit(1)).alias("times"))
    stays = Scratch(docs.sparkSession, "kept").keep(stays.select(F.col("id").alias("of_id"), F.col("exact").alias("of_text"), ((F.col("times") == 1) | (F.col("wordless") & F.col("id").isNull())).alias("all")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("exact"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("exact") == F.col("of_text"))
    out = rows.join(bounded(stays.where("all")), same, "left_semi")
    repeated = stays.where("not all")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(bounded(repeated), same, "left_semi").dropDuplicates(["id", "exact"]))
    return out.select("doc.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: The exact join: all pairs of classes that share a shingle, and components by recursion. For small tables.
OP6_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
k as (select doc_id, array_to_string(words, ' ') as key, words from w),
c as (select key, min(doc_id) as rep, count(*) as n_copies, any_value(words) as words from k where key <> '' group by key),
s as (select distinct rep, unnest(case when len(words) < 5 then [key] else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as sh from c),
n as (select rep, count(*) as n from s group by rep),
p as (select a.rep as a, b.rep as b, count(*) as common from s a join s b on a.sh = b.sh and a.rep <> b.rep group by all),
l as (select a, b from p join n na on na.rep = a join n nb on nb.rep = b where common >= 0.8 * (na.n + nb.n - common)),
r(id, root) as (select rep, rep from c union select l.a, r.root from r join l on l.b = r.id),
g as (select id, min(root) as root from r group by id),
d as (select a as id, count(*) as n_links from l group by a)
select doc_id, coalesce(c.rep, doc_id) as class_id, coalesce(n_copies, 1) as n_copies, coalesce(n_links, 0) as n_links, coalesce(g.root, doc_id) as component_id, doc_id = coalesce(g.root, doc_id) as kept
from k left join c on c.key = k.key left join g on g.id = c.rep left join d on d.id = c.rep
"""
