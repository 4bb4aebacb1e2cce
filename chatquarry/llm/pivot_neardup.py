"""Near duplicates of vectors: a pivot-permutation index with inverted pivot lists, then exact cosines.

A vector is described by its nearest pivots in order. An inverted list holds, of each pivot, the vectors that name it
and the place at which they do; two vectors are candidates if they share enough pivots at places that differ little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ALIVE_KIND, Scratch, alive, block_pairs, bounded, by_key, by_task, components, deal, in_arrow, links_of, narrow, stars, table

#: Key of a list: a hash of label and dimension in the upper bits, then the pivot.
PIVOT_BITS = 20
#: Pivots by the square root of the largest label's vectors, and at most; dimensions with pivots, the commonest first.
PIVOTS_ROOT, LEAST_PIVOTS, MOST_PIVOTS, MOST_DIMS = 16, 64, 16_384, 1_000


def _vectors(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; they are scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _spread(sample: np.ndarray, most: int, apart: float = 0.7) -> np.ndarray:
    """The first `most` vectors of the sample, as units, that have a cosine below `apart` to all taken before.

    Pivots amid one group of near copies would order that group's members by noise.
    """
    taken, n = np.empty((most, sample.shape[1])), 0
    for v in _unit(sample):
        if n < most and (not n or (taken[:n] @ v).max() < apart):
            taken[n], n = v, n + 1
    return taken[:n]


def _pivots(entries: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Pivots by dimension, from a sample of hashed entries; their number grows as the root of the largest label."""
    sized = entries.groupBy(F.size("vec").alias("dim"), "lab").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    wanted = {r.dim: (int(np.clip(PIVOTS_ROOT * r.most**0.5, LEAST_PIVOTS, MOST_PIVOTS)), r.n) for r in sized.orderBy(F.desc("n"), "dim").limit(MOST_DIMS).collect()}
    if not wanted:
        return {}
    share = entries.sparkSession.createDataFrame([(dim, min(1.0, 4.0 * p / n)) for dim, (p, n) in wanted.items()], "dim int, share double")
    order = F.xxhash64(F.lit(seed), "id")
    some = entries.select("id", "vec", F.size("vec").alias("dim"), order.alias("h")).join(F.broadcast(share), "dim")
    some = some.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("dim", "h", "vec").toArrow()
    dims, order = some.column("dim").to_numpy(), some.column("h").to_numpy()
    vectors = _vectors(some.column("vec")) if some.num_rows else []
    out = {}
    for dim, (p, _) in wanted.items():
        at = np.flatnonzero(dims == dim)
        if len(at):
            out[dim] = _spread(np.stack([vectors[k] for k in at[np.argsort(order[at], kind="stable")]]), p)
    return out


def _nearest(pivots: dict[int, np.ndarray], take: int):
    """Describes each vector: its `take` nearest pivots in order, and the keys of their lists."""
    schema = pa.schema([("id", pa.int64()), ("lab", pa.int64()), ("pivots", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, space = _vectors(batch.column("vec")), batch.column("space").to_numpy()
            near: list = [[0]] * len(vectors)  # a dimension without pivots has one list a label
            sizes = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(sizes):
                if int(dim) not in pivots:
                    continue
                at, points = np.flatnonzero(sizes == dim), pivots[int(dim)]
                far = -(_unit(np.stack([vectors[i] for i in at])) @ points.T)
                k = min(take, len(points))
                first = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
                order = np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, 1), axis=1, kind="stable"), 1)
                for i, o in zip(at, order):
                    near[i] = o.tolist()
            with np.errstate(over="ignore"):
                base = space << np.int64(PIVOT_BITS)
            keys = [[int(b) | p for p in n] for b, n in zip(base, near)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lab"), pa.array(near, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes)], schema=schema)

    return run, "id long, lab long, pivots array<int>, keys array<long>, weight long"


#: Rows of a task up to which descriptions are compared value by value.
SMALL_LIST = 160


def _compared(row: np.ndarray, pivot: np.ndarray, place: np.ndarray, n: int, deep: int, slack: int, here: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of rows, how many pivots they share at places that differ little, and how many below `here`."""
    of = np.full((n, deep), -1, np.int32)
    of[row, place] = pivot
    other = np.where(of < 0, -2, of)
    common, lower = np.zeros((n, n), np.int16), np.zeros((n, n), np.int16)
    below = of < here
    for a in range(deep):
        for b in range(deep):
            same = of[:, a, None] == other[None, :, b]
            lower += same & below[:, a, None]
            if abs(a - b) <= slack:
                common += same
    return common, lower


def _multiplied(row: np.ndarray, pivot: np.ndarray, place: np.ndarray, n: int, deep: int, slack: int, here: int) -> tuple[np.ndarray, np.ndarray]:
    """As _compared(), by products of matrices: a row's places, against the places that lie near another row's."""
    _, code, times = np.unique(pivot, return_inverse=True, return_counts=True)
    some = times[code] > 1  # a pivot that one row names is shared with none
    names, code = np.unique(pivot[some], return_inverse=True)
    row, place, deep = row[some], place[some], deep + 2 * slack
    common, lower = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    step = max(1, 2048 // deep)
    for a in range(0, len(names), step):
        at = (code >= a) & (code < a + step)
        r, c, p = row[at], code[at] - a, place[at]
        one, near = np.zeros((n, step, deep), np.float32), np.zeros((n, step, deep), np.float32)
        one[r, c, p + slack] = 1
        for d in range(2 * slack + 1):
            near[r, c, p + d] = 1
        common += one.reshape(n, -1) @ near.reshape(n, -1).T
        below = np.zeros(step, bool)
        below[: len(names[a : a + step])] = names[a : a + step] < here
        if below.any():
            has = one.sum(axis=2)[:, below]
            lower += has @ has.T
    return common, lower


def _candidates(group: pa.Table, shared: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task's rows that share enough pivots, and belong to this list as that of their smallest common pivot."""
    blk, lab = group.column("blk").to_numpy(), group.column("lab").to_numpy()
    i, j, here = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("key")[0].as_py() & ((1 << PIVOT_BITS) - 1)
    lists = group.column("pivots").combine_chunks()
    size, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    common, lower = (_compared if len(blk) <= SMALL_LIST else _multiplied)(np.repeat(np.arange(len(blk)), size), flat, place, len(blk), int(size.max()), slack, here)
    pair = (common >= np.minimum(shared, np.minimum.outer(size, size))) & (lower == 0) & (lab[:, None] == lab[None, :])
    pair = np.triu(pair, 1) if i == j else pair & np.outer(blk == i, blk == j)
    return np.nonzero(pair)


def _retrieve(shared: int, slack: int):
    """Of each task the rows that have a candidate there: vectors are fetched for these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key", "i", "j"]):
            if group.num_rows > 1:
                x, y = _candidates(group, shared, slack)
                if len(x):
                    yield alive(group, np.unique(np.concatenate([x, y])))

    return run, ALIVE_KIND


def _verify(threshold: float, shared: int, slack: int):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key", "i", "j"]):
            if group.num_rows < 2:
                continue
            x, y = _candidates(group, shared, slack)
            vectors = _vectors(group.column("vec"))
            dims = np.array([len(v) for v in vectors])
            x, y = x[dims[x] == dims[y]], y[dims[x] == dims[y]]
            ok = np.zeros(len(x), bool)
            for dim in np.unique(dims[x]):
                rows, at = np.flatnonzero(dims == dim), np.flatnonzero(dims[x] == dim)
                place = np.zeros(len(vectors), np.int64)
                place[rows] = np.arange(len(rows))
                unit = _unit(np.stack([vectors[k] for k in rows]))
                if len(at) > 8 * len(rows):
                    ok[at] = (unit @ unit.T)[place[x[at]], place[y[at]]] >= threshold
                    continue
                for a in range(0, len(at), 20_000):
                    part = at[a : a + 20_000]
                    ok[part] = np.einsum("ij,ij->i", unit[place[x[part]]], unit[place[y[part]]]) >= threshold
            if ok.any():
                ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
                x, y = x[ok], y[ok]
                count, root = stars(ids, x, y)
                links = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
                some = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], schema=schema)

    return run, "id long, links long, root long"


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, nearest: int = 6, shared: int = 2, slack: int = 3, seed: int = 42) -> DataFrame:
    """Links vectors of equal label whose cosine is `threshold` at least, in double precision.

    Returns one row per input row: id_col, n_links long (other vectors linked directly), component_id (the smallest
    id reachable by links, itself included) and kept boolean (id = component_id). Ids and labels may have any type.

    Each vector is described by its `nearest` nearest pivots in order. Pivots are vectors of a bounded sample that
    are not near another; there are as many as PIVOTS_ROOT times the root of the largest label's vectors, so lists
    grow as the root too. Vectors of a label are candidates if they share `shared` pivots at places that differ by
    `slack` at most. Lists are compared in bounded blocks, without a cap: descriptions alone first, then, of the rows
    that have a candidate, the vectors. Dimensions beyond the MOST_DIMS commonest have no pivots; their vectors are
    compared with all of their label and dimension. Equal vectors of a label are one entry of the index, their copies
    count as links.
    Null labels, null, empty and zero vectors, and vectors with null, NaN or infinite components link with nothing,
    nor do rows without an id; vectors of different dimensions are not compared. An empty table gives an empty
    result; other columns are ignored, whatever their names. Rows that repeat an id count as copies where their
    vectors are equal; else each vector is compared by itself, and they share a component.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    kind = "array<float>" if kind_is_float(vectors, vec_col) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = scratch.keep(rows.withColumn("valid", valid).withColumn("key", F.xxhash64("label", "vec")), "vectors", wide=True)
    reps = rows.where("valid").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.keep(reps.select(F.xxhash64("label", "vec").alias("id"), F.xxhash64("label").alias("lab"), "least", "vec", "copies"), "entries", each=4)
    run, kind = _nearest(_pivots(reps, seed), nearest)
    index = scratch.keep(in_arrow(reps.select("id", "lab", F.xxhash64("lab", F.size("vec")).alias("space"), "vec"), run, kind), "index", wide=True)
    met = block_pairs(index, 1024, 1 << 20)
    run, kind = _retrieve(shared, slack)
    described = index.select("id", "lab", "pivots")
    found = scratch.keep(in_arrow(deal(met.join(described, "id"), ["lab", "pivots"]), run, kind), "candidates", each=4)
    run, kind = _verify(threshold, shared, slack)
    found = scratch.keep(links_of(in_arrow(by_task(found.join(described, "id").join(reps.select("id", "vec", "copies"), "id")), run, kind)), "links")
    several = rows.where("valid").groupBy("id").agg(F.min("key").alias("b"), F.max("key").alias("hi")).where("b <> hi").select("id", "b")
    several = rows.where("valid").join(bounded(several), "id").select(F.col("key").alias("a"), "b")
    group = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(several), scratch)
    about = reps.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(group, reps.id == group.node, "left")
    about = about.select(reps.id.alias("key"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", reps.id).alias("root"))
    about = about.join(about.groupBy("root").agg(F.min("least").alias("component")), "root")
    out = rows.where("valid").join(about, "key").select("id", "n_links", "component")
    out = out.unionByName(rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return narrow(out).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def kind_is_float(vectors: DataFrame, column: str) -> bool:
    """Single-precision vectors travel as they are; every other kind as doubles."""
    return vectors.select(F.col(column)).dtypes[0][1] == "array<float>"


def op7_pivot_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The exact result: all pairs of a label by cosine, and components by recursion. For small tables.
OP7_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, root) as (select vec_id, vec_id from embeddings union select l.a, r.root from r join l on l.b = r.id),
g as (select id, min(root) as root from r group by id), d as (select a as id, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, g.root as component_id, vec_id = g.root as kept from embeddings join g on g.id = vec_id left join d on d.id = vec_id
"""
