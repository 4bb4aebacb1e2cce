"""Quality of texts by ordinal cumulative-link regression on hashed words and word shapes, learned from graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded, crc_of, hash_order, in_arrow, kind_of, sub_batches, table

#: Bits of the hashed features: words, shapes of words, pairs of shapes (a word said twice running is one of these).
WORD_BITS, SHAPE_BITS, PAIR_BITS = 13, 11, 12
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS) + (1 << PAIR_BITS)

_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[[*range(97, 123), *range(128, 256)]] = 97
_SHAPES[65:91] = 65
_SHAPES[48:58] = 48
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hash(values: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; starts are the runs' beginnings, place a byte's position in its run."""
    x = (values.astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(9))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    x = np.add.reduceat(x ^ (x >> np.uint64(32)), starts) if len(starts) else np.zeros(0, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the hashed features of every word, three to a word, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    none = np.zeros((0, 3), np.int64), np.zeros(len(texts), np.int64)
    if at[-1] == at[0]:
        return none
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    first = np.zeros(len(raw), bool)
    first[at[:-1][at[:-1] < len(raw)]] = True
    begin = inside & (np.concatenate([[True], ~inside[:-1]]) | first)
    begins = np.flatnonzero(begin)
    if not len(begins):
        return none
    word = np.cumsum(begin) - 1

    def runs(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
        owner, values = word[keep], values[keep]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        return _hash(values, starts, np.arange(len(owner)) - starts[owner])

    lower = np.where((raw >= 65) & (raw < 91), raw + 32, raw).astype(np.uint8)
    shape = _SHAPES[raw]
    changes = np.concatenate([[True], shape[1:] != shape[:-1]]) | begin
    words, shapes = runs(lower, inside), runs(shape, inside & changes)
    counts = np.diff(np.searchsorted(begins, at))
    opens = np.zeros(len(begins), bool)
    opens[(np.concatenate([[0], np.cumsum(counts)])[:-1])[counts > 0]] = True
    before = np.where(opens, np.uint64(0), np.concatenate([[np.uint64(0)], shapes[:-1]]))
    again = np.concatenate([[False], words[1:] == words[:-1]]) & ~opens
    pairs = np.where(again, np.uint64(0), (shapes ^ (before * _B)) * _A)
    out = np.empty((len(begins), 3), np.int64)
    out[:, 0] = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    out[:, 1] = (shapes >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
    out[:, 2] = (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + (1 << WORD_BITS) + (1 << SHAPE_BITS)
    return out, counts


@dataclass
class Grader:
    """Shared weights of the hashed features, ordered thresholds between the grades, and the grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]


def labelled(docs: DataFrame, labels: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(text, grade) of at most `most` rated rows, those with the smallest hashes.

    A text or an id with two ratings has the lower; null ratings and rows without an id don't count. Null texts are one
    row, as all equal texts are. Empty tables give none; other columns are ignored. Ids may have any type.
    """
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("grade"))
    chosen = bounded(rows.orderBy(hash_order("doc_id", seed=seed), "doc_id").limit(most), most)
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("text").agg(F.min("grade").alias("grade"))


def _sparse():
    schema = pa.schema([("grade", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                with np.errstate(over="ignore"):
                    index, counts = features(batch.column("text"))
                ends = np.cumsum(counts)
                found = [np.unique(index[b - n : b], return_counts=True) for n, b in zip(counts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int32()), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([(n / max(1, c)).astype(np.float32) for (_, n), c in zip(found, counts)], pa.list_(pa.float32()))], schema=schema)

    return run, "grade int, index array<int>, value array<float>"


def fit(indices: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, rounds: int = 250, ridge: float = 2e-5, rate: float = 0.3) -> Grader:
    """Maximum likelihood of P(grade <= k) = logistic(threshold_k - f), f the mean weight of a text's features, by Adam.

    All thresholds share the weights and stay ordered: each is the one before plus an exponential.
    """
    names = sorted(set(int(g) for g in grades))
    k = len(names)
    y = np.searchsorted(names, grades)
    if k < 2:
        return Grader(np.zeros(WIDTH), np.zeros(0), names or [0])
    row, col, val = np.repeat(np.arange(len(indices)), [len(i) for i in indices]), np.concatenate(indices), np.concatenate(values).astype(np.float64)
    share = np.clip(np.array([(y <= j).mean() for j in range(k - 1)]), 1e-4, 1 - 1e-4)
    cut = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(WIDTH), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for step in range(1, rounds + 1):
        w, gaps = params[:WIDTH], np.exp(params[WIDTH + 1 :])
        theta = params[WIDTH] + np.concatenate([[0], np.cumsum(gaps)])
        f = np.bincount(row, val * w[col], len(y))
        up = np.where(y < k - 1, logistic(theta[np.minimum(y, k - 2)] - f), 1.0)
        down = np.where(y > 0, logistic(theta[np.maximum(y, 1) - 1] - f), 0.0)
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        grad_theta = np.zeros(k - 1)
        np.add.at(grad_theta, np.minimum(y, k - 2), -np.where(y < k - 1, du, 0))
        np.add.at(grad_theta, np.maximum(y, 1) - 1, np.where(y > 0, dd, 0))
        grad = np.concatenate([np.bincount(col, val * (du - dd)[row], WIDTH) / len(y) + 2 * ridge * w, [grad_theta.sum() / len(y)], [grad_theta[j + 1 :].sum() * gaps[j] / len(y) for j in range(k - 2)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Grader(params[:WIDTH], params[WIDTH] + np.concatenate([[0], np.cumsum(np.exp(params[WIDTH + 1 :]))]), names)


def learn(rows: DataFrame) -> Grader:
    """A grader from rows (text, grade), a bounded sample: its hashed features, at most WIDTH a text, go to the driver.

    Null and empty texts have no features and count for the thresholds alone. Without rows, or with one grade, all
    texts have the only grade (0 without rows).
    """
    run, kind = _sparse()
    found = in_arrow(rows.repartition(24), run, kind).toArrow()
    indices, values = ([np.asarray(x.values) for x in found.column(c)] for c in ("index", "value"))
    grades = found.column("grade").to_numpy()
    order = sorted(range(len(grades)), key=lambda i: (grades[i], len(indices[i]), indices[i].tobytes()))  # the rows come in any order
    return fit([indices[i] for i in order], [values[i] for i in order], grades[order])


def _score(grader: Grader, at_least: int | None):
    """A function from texts to their expected grades and tail probabilities."""
    weights, thresholds, grades = grader.weights.astype(np.float64), grader.thresholds, np.array(grader.grades, np.float64)
    least = at_least if at_least is not None else grader.grades[min(1, len(grader.grades) - 1)]

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            index, counts = features(texts)
        some = counts > 0
        f = np.zeros(len(counts))
        if some.any():  # each text's sum by itself, so that it doesn't depend on its neighbours
            f[some] = np.add.reduceat(weights[index].sum(axis=1), (np.cumsum(counts) - counts)[some]) / counts[some]
        below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - f[:, None], -35, 35)))
        p = np.diff(np.concatenate([np.zeros((len(f), 1)), below, np.ones((len(f), 1))], axis=1), axis=1)
        return p @ grades, p[:, grades >= least].sum(axis=1)

    return score


def grade(docs: DataFrame, grader: Grader, at_least: int | None = None, select: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grades every whole text: id_col, expected_grade double, tail double, keep boolean.

    tail is P(grade >= at_least), by default the second lowest grade; keep is tail >= select. Texts that are null or
    have no words get the grade that the thresholds alone give. With fewer than two grades learned, expected_grade is
    the only one, tail 1 and all are kept. Ids may have any type, null too; a text's grade follows from it alone, so
    rows that repeat have equal grades on any partitioning; very long texts are graded whole, an empty table gives an
    empty result, other columns are ignored.
    """
    score = _score(grader, at_least)
    names = ["id", "expected_grade", "tail", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                expected, tail = score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(expected), pa.array(tail), pa.array(tail >= select)], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, f"id {kind_of(docs, id_col)}, expected_grade double, tail double, keep boolean").withColumnRenamed("id", id_col)


def select(docs: DataFrame, grader: Grader, at_least: int | None = None, select: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that grade() would keep, with all their columns, in one pass.

    Each row is judged by its text alone, null and empty ones by the thresholds; columns may have any names.
    """
    score = _score(grader, at_least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, text_col):
                yield batch.filter(pa.array(score(batch.column(text_col))[1] >= select))

    return in_arrow(docs, run, docs.schema)


#: Rated rows that a grader is learned from, at most, and the tail probability at which a document is selected.
SAMPLE, SELECT = 5_000, 0.5


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc_of("doc_id"), F.lit(5)) == 0
    grader = learn(labelled(docs, labels.where(~held_out), SAMPLE))
    return grade(docs, grader, select=SELECT).withColumn("held_out", held_out)
