"""Tensors and matrices as blocks of a fixed size: weighted merges, dropping and rescaling, products.

A block is a row with an array, so that a shuffle moves few rows and numbers are added as arrays. Sums are made within
each task before they are shuffled, so a name that most rows have is a few partial blocks, not one task's whole load.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a block, and bytes of partial sums that a task holds before it hands them on.
BLOCK, HELD = 4096, 64 << 20
#: Adapters of one merge.
MOST_ADAPTERS = 11
_KIND = "name string, i long, j long, n long, width int, values array<double>"


def cut(tensors: DataFrame, vector: str, size: int = BLOCK) -> DataFrame:
    """A row for each stretch of `size` numbers of `vector`: block long (from 0) and values array<double> in its place.

    Null and empty vectors have none. The two names must not be columns besides it.
    """
    count = F.ceil(F.size(vector) / size).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.cast("long").alias("block"), F.slice(vector, k * size + 1, size).cast("array<double>").alias("values")))
    pieces = F.when(F.size(vector) > 0, pieces)
    others = [c for c in tensors.columns if c != vector]
    return tensors.withColumn("__p", F.explode(pieces)).select(*others, "__p.block", "__p.values")


def join(blocks: DataFrame, vector: str = "values") -> DataFrame:
    """(name, vector) from (name, block, values): the stretches of each name in order, in one row."""
    rows = blocks.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("block", "values"))).alias("__b"))
    return rows.select("name", F.flatten(F.transform("__b", lambda b: b["values"])).alias(vector))


def _numbers(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _rows(held: dict) -> pa.RecordBatch:
    """Partial sums as rows; an array's elements that no block had are NaN already, as are null ones."""
    names, i, j, n, width, values = zip(*[(*k, *v) for k, v in held.items()]) if held else [()] * 6
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *values])))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip((names, i, j, n, width), kinds)), lists], names=["name", "i", "j", "n", "width", "values"])


def _add(held: dict, key: tuple, n: int, width: int, values: np.ndarray) -> int:
    """Adds a block to the sum of its key; the bytes by which what is held has grown."""
    if key not in held:
        held[key] = (n, width, np.array(values, np.float64))
        return 8 * len(values) + 200
    m, w, total = held[key]
    if len(total) != len(values) or w != width:
        raise ValueError(f"blocks of {key} differ in size: {len(total)} numbers in rows of {w}, {len(values)} in rows of {width}")
    total += values
    held[key] = (m + n, w, total)
    return 0


def _summed(rows: DataFrame, blocks_of: Callable[[pa.RecordBatch], Iterator[tuple[tuple, int, int, np.ndarray]]]) -> DataFrame:
    """(name, i, j, n, width, values): sums of the blocks that blocks_of() yields as (key, n, width, numbers), within tasks first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for key, n, width, values in blocks_of(batch):
                size += _add(held, key, n, width, values)
                if size > HELD:
                    yield _rows(held)
                    held, size = {}, 0
        yield _rows(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for *key, n, width, values in zip(*(batch.column(c).to_pylist() for c in ("name", "i", "j", "n", "width")), _numbers(batch.column("values"))):
                if tuple(key) not in held and len(held) > 0:  # rows come sorted by key
                    yield _rows(held)
                    held = {}
                _add(held, tuple(key), n, width, values)
        yield _rows(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.mapInArrow(part, _KIND).repartition(parts, "name", "i", "j").sortWithinPartitions("name", "i", "j")
    return some.mapInArrow(whole, _KIND)


def _dropped(values: np.ndarray, drop: float, seed: int, key: str, first: int) -> np.ndarray:
    """The numbers of which each is 0 with probability `drop`, the others divided by 1 - drop.

    The choice follows from seed, key and the number's place in its tensor: 64-bit mixing by multiplications and shifts.
    """
    if not drop:
        return values
    import zlib

    with np.errstate(over="ignore"):
        x = np.arange(first, first + len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(f"{seed}|{key}".encode()) << 17 | 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.where(x >> np.uint64(11) >= np.uint64(round(drop * (1 << 53))), values / (1 - drop), 0.0)


def weighted_sums(blocks: DataFrame, weight: str | None = None) -> DataFrame:
    """(name, block, n, values) from (name, block, values): the sum, times weight where it is given, over the n blocks of each.

    Blocks of one name and number that differ in size are an error. A null number makes the sum there NaN; a block
    with a null weight is left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = blocks.select(F.col("name").cast("string").alias("name"), F.col("block").cast("long").alias("block"), w.alias("w"), "values").where("w is not null")

    def of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
        for name, block, w, values in zip(*(batch.column(c).to_pylist() for c in ("name", "block", "w")), _numbers(batch.column("values"))):
            yield (name, block, 0), 1, 0, w * values

    return _summed(rows, of).select("name", F.col("i").alias("block"), "n", "values")


def merge(blocks: DataFrame, weights: dict[str, float], drop: float = 0.0, seed: int = 42, size: int = BLOCK, strict: bool = True) -> DataFrame:
    """(name, block, values): the weighted sum of several adapters' tensors, from (adapter, name, block, values).

    weights is by adapter and sums to one. Every adapter must have the same names, blocks and sizes, which the sum's
    own pass shows: a name that an adapter lacks or has twice, or an adapter without a weight, is an error when the
    result is read. Without `strict`, names of which there are more or fewer blocks than adapters are left out instead.
    With `drop`, each adapter's numbers are dropped and rescaled on the way; size is that of cut().
    """
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    if not 0 <= drop < 1:
        raise ValueError("drop must be in [0, 1)")
    order = {a: k for k, a in enumerate(sorted(weights))}
    rows = blocks.select(F.col("adapter").cast("string").alias("adapter"), F.col("name").cast("string").alias("name"), F.col("block").cast("long").alias("block"), "values")

    def of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
        for adapter, name, block, values in zip(*(batch.column(c).to_pylist() for c in ("adapter", "name", "block")), _numbers(batch.column("values"))):
            if adapter not in weights:
                raise ValueError(f"no weight for the adapter {adapter}")
            # n counts all blocks, and each adapter's in a digit of its own: with both, one there twice can't stand in for another
            yield (name, block, 0), 1 + (1 << 16 + 4 * order[adapter]), 0, weights[adapter] * _dropped(values, drop, seed, f"{adapter}|{name}", block * size)

    if len(weights) > MOST_ADAPTERS:
        raise ValueError(f"more than {MOST_ADAPTERS} adapters at once")
    every = sum(1 + (1 << 16 + 4 * k) for k in order.values())
    told = F.concat(F.lit("adapters differ in their tensors: not all have one "), F.col("name"), F.lit(", block "), F.col("i").cast("string"))
    checked = F.when(F.col("n") != every, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    if not strict:
        checked = F.col("n") % (1 << 16) == len(weights)
    return _summed(rows, of).where(checked).select("name", F.col("i").alias("block"), "values")


def matrix(rows: DataFrame, row: str, vector: str, high: int, wide: int) -> DataFrame:
    """Blocks (i, j, width, values) of a matrix given by rows of numbers: high rows by wide columns each, row after row.

    Rows are numbered from 0 without gaps; a row that is missing or has another length makes a block whose size
    another operand's doesn't fit, which is an error there.
    """
    at = F.col(row).cast("long")
    some = cut(rows.select(at.alias("__row"), F.col(vector).alias("__v")), "__v", wide)
    some = some.groupBy(F.floor(F.col("__row") / high).alias("i"), F.col("block").alias("j")).agg(F.sort_array(F.collect_list(F.struct("__row", "values"))).alias("__r"))  # `high` rows a block
    return some.select("i", "j", F.size(F.get("__r", F.lit(0))["values"]).alias("width"), F.flatten(F.transform("__r", lambda r: r["values"])).alias("values"))


def matrix_rows(blocks: DataFrame, high: int) -> DataFrame:
    """(row, values) of matrix()'s blocks, the numbers of each row in one array."""
    line = lambda k: F.slice("values", k * F.col("width") + 1, F.col("width"))
    lines = F.transform(F.sequence(F.lit(0), (F.size("values") / F.col("width")).cast("int") - 1), lambda k: F.struct((F.col("i") * high + k).alias("row"), line(k).alias("part")))
    parts = blocks.select("j", F.explode(lines).alias("x")).groupBy("x.row").agg(F.sort_array(F.collect_list(F.struct("j", "x.part"))).alias("p"))
    return parts.select("row", F.flatten(F.transform("p", lambda p: p.part)).alias("values"))


def fold(base: DataFrame, left: DataFrame, right: DataFrame, scale: float) -> DataFrame:
    """base + scale * left x right, each as matrix()'s blocks: (i, j, width, values).

    left's blocks (i, k) meet right's (k, j) by a join on k; each pair is one product, products of the same (i, j)
    are added within tasks, then with the base's block. All blocks of left must be as wide as right's of the same k
    are high, products as large as the base's, and every (i, j) have one for each k; else it is an error when the
    result is read.
    """
    a = left.select("i", F.col("j").alias("k"), F.col("width").alias("a_width"), F.col("values").alias("a"))
    b = right.select(F.col("i").alias("k"), "j", F.col("width").alias("b_width"), F.col("values").alias("b"))
    pairs = a.join(b, "k").select("i", "j", "a_width", "b_width", "a", "b")
    both = pairs.unionByName(base.select("i", "j", F.lit(None).cast("int").alias("a_width"), F.col("width").alias("b_width"), F.lit(None).cast("array<double>").alias("a"), F.col("values").alias("b")))

    def of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
        columns = (batch.column(c).to_pylist() for c in ("i", "j", "a_width", "b_width"))
        for i, j, inner, width, x, y in zip(*columns, _numbers(batch.column("a")), _numbers(batch.column("b"))):
            if inner is None:
                yield ("", i, j), 1, width, y
            elif len(x) % inner or len(y) != inner * width:
                raise ValueError(f"blocks of {len(x)} numbers in rows of {inner} and {len(y)} in rows of {width} have no product")
            else:
                yield ("", i, j), 1 << 20, width, scale * (x.reshape(-1, inner) @ y.reshape(inner, width)).ravel()

    out = _summed(both, of)
    last = left.select("j").unionByName(right.select(F.col("i").alias("j"))).agg(F.coalesce(F.max("j") + 1, F.lit(0)).alias("__k"))
    out = out.crossJoin(F.broadcast(last))  # one row
    told = F.concat(F.when(F.col("n") % (1 << 20) != 1, F.lit("the base has no block ")).otherwise(F.lit("a product is lacking for block ")), F.col("i").cast("string"), F.lit(", "), F.col("j").cast("string"))
    return out.where(F.when(F.col("n") != 1 + F.col("__k") * (1 << 20), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).select("i", "j", "width", "values")
