"""Toxicity by a weighted lexicon: folded texts, an Aho-Corasick automaton, exception phrases, a score normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, bounded, crc_of, hash_order, in_arrow, kind_of, sub_batches, table

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁѵɡαορνικτυтвнкм", "aeopcyxijshdvgaopviktutbhkm", strict=True))
#: Digits and signs that stand for letters, alone or in a run, where they touch a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a term of the lexicon is harmless, besides those that learn() finds.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "trash bag", "sore loser")

#: Signs that are dropped: zero-width ones, and the blocks of combining marks.
DROPPED = (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30))
FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord("ı"): "i", ord("ł"): "l", ord("ø"): "o", ord("đ"): "d"} | dict.fromkeys(DROPPED)
_RUN, _DIGITS = re.compile(r"(?<=[a-z])[0134578@$]+|[0134578@$]+(?=[a-z])"), str.maketrans(SUBSTITUTES)
#: Three letters or more, each by itself with a dot, a star or the like between.
_SPACED = re.compile(r"(?<![^\W_])[a-z](?:[.*_\-][a-z]){2,}(?![^\W_])")
_MARKS = re.compile(r"[.*_\-]")
#: What a text must hold for these to apply; found much faster than they are.
_HAS_DIGIT, _HAS_SPACED = re.compile(r"[0134578@$]"), re.compile(r"[.*_\-][a-z][.*_\-][a-z]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, homoglyphs and styled letters as Latin ones, digit substitutions undone, letters set
    apart by dots together, zero-width and combining signs gone."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower().translate(FOLD)
    if _HAS_DIGIT.search(text):
        text = _RUN.sub(lambda m: m[0].translate(_DIGITS), text)
    return _SPACED.sub(lambda m: _MARKS.sub("", m[0]), text) if _HAS_SPACED.search(text) else text


@dataclass
class Lexicon:
    """Terms by weight (`^abc` the start of a word, `^abc$` a whole word) and the score's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    exceptions: tuple[str, ...] = EXCEPTIONS


def _terms(words: list[str], lengths: tuple[int, ...]) -> list[set[str]]:
    return [{f"^{w}$", *(f"^{w[:n]}" for n in lengths if len(w) > n)} for w in words]


def _count(lengths: tuple[int, ...]):
    """Of labelled texts: for clean ones the words by term; for toxic ones each term with its context and text.

    The empty term stands for all words.
    """
    schema = pa.schema([("term", pa.string()), ("context", pa.int64()), ("doc", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (part for whole in batches for part in sub_batches(whole, "text", 200_000)):
            clean: Counter = Counter()
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = _WORD.findall(fold(text or ""))
                if toxic:
                    doc = xxhash.xxh64_intdigest(text or "") >> 1
                    seen = set()
                    for k, terms in enumerate(_terms(words, lengths)):
                        context = xxhash.xxh64_intdigest(" ".join(words[max(0, k - 1) : k + 2])) >> 1
                        seen |= {(t, context) for t in terms} | {("", context)}
                    rows += [(t, c, doc, 1) for t, c in seen]
                else:
                    clean[""] += len(words)
                    for word, n in Counter(words).items():
                        for t in _terms([word], lengths)[0]:
                            clean[t] += n
            rows += [(t, None, None, n) for t, n in clean.items()]
            for a in range(0, len(rows), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 200_000]), schema)], schema=schema)

    return run, "term string, context long, doc long, n long"


def labelled(docs: DataFrame, labels: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows with distinct texts, those with the smallest hashes.

    A text or an id that is labelled both ways is toxic; labels other than 0 and 1, nulls included, and rows without
    an id don't count. Null texts are one row, as all equal texts are. Empty tables give none; other columns are
    ignored, whatever their names. Ids may have any type.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded(rows.orderBy(hash_order("doc_id", seed=seed), "doc_id").limit(most), most)
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def learn(rows: DataFrame, min_docs: int = 3, min_share: float = 0.01, min_z: float = 3.0, least_odds: float = 2.7, most_terms: int = 5000, most_weight: float = 10.0, min_excused: int = 5, lengths: tuple[int, ...] = (4, 5, 6, 7), exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from rows (text, toxic), a bounded sample.

    A term's toxic support is the number of its distinct contexts (the words beside it), so that words shared by
    copies of one text don't count as evidence; it is held against its occurrences in clean texts. Terms in `min_docs`
    texts (and `min_share` of the toxic ones) and twice as many contexts, with a log odds ratio and a z value of the
    given size, are candidates, the `most_terms` with the largest z; of a word and its beginnings the longest is kept
    that loses no more than a tenth of the support. A term's weight is its log odds ratio, `most_weight` at most, so
    that a term no clean text holds doesn't outweigh all others. A word beside a hit makes an exception phrase if it
    stands there in `min_excused` distinct contexts of clean texts and in no toxic one.
    Null and empty texts hold no terms; long ones are read whole, in parts. Without rows of both labels, as with an
    empty table, the lexicon is empty.
    """
    scratch = Scratch(rows.sparkSession, "toxicity")
    rows = scratch.keep(rows.repartition(12), "labelled")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon(exceptions=exceptions)
    run, kind = _count(lengths)
    counted = scratch.keep(in_arrow(rows, run, kind), "terms")
    bad = counted.where("doc is not null").groupBy("term").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("context").alias("a"))
    good = counted.where("doc is null").groupBy("term").agg(F.sum("n").alias("b"))
    both = scratch.keep(bad.join(good, "term", "left").select("term", "docs", "a", F.coalesce("b", F.lit(0)).alias("b")), "counts")
    every = both.where("term = ''").first()
    if every is None or not every.a:
        return Lexicon(exceptions=exceptions)
    odds = F.log((F.col("a") + 0.5) / (every.a + 1)) - F.log((F.col("b") + 0.5) / (every.b + 1))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    both = both.where((F.col("term") != "") & (F.col("a") >= 2 * min_docs) & (F.col("docs") >= max(min_docs, min_share * toxic)))
    found = both.withColumns({"odds": odds, "z": z}).where((F.col("odds") >= least_odds) & (F.col("z") >= min_z)).orderBy(F.desc("z"), "term").limit(most_terms).collect()
    support = {r.term: (r.a, r.odds) for r in found}
    weights = {}
    for term, (a, w) in support.items():
        stem = term[1:].rstrip("$")
        longer = [t for t in support if t != term and t.startswith(term.rstrip("$"))] if not term.endswith("$") else []
        if any(support[t][0] >= 0.9 * a for t in longer):
            continue
        shorter = [f"^{stem[:k]}" for k in lengths if k < len(stem) + term.endswith("$")]
        if any(t in support and support[t][0] * 0.9 > a for t in shorter):
            continue
        weights[term] = round(min(w, most_weight), 6)
    beside = in_arrow(rows, _beside(weights), "phrase string, context long, toxic int").groupBy("phrase").agg(F.countDistinct(F.when(F.col("toxic") == 0, F.col("context"))).alias("a"), F.max("toxic").alias("b"))
    excused = [r.phrase for r in beside.where((F.col("a") >= min_excused) & (F.col("b") == 0)).orderBy(F.desc("a"), "phrase").limit(most_terms).collect()]
    lexicon = Lexicon(weights, exceptions=tuple(dict.fromkeys((*exceptions, *excused))))
    scan = _scan(lexicon)
    seen = in_arrow(rows.select("text", "toxic"), _with_label(scan), "hits double, words long, toxic int")
    data = np.array([(r.hits, r.words, r.toxic) for r in seen.collect()], np.float64)  # as many rows as the sample
    lexicon.coefficients = _fit(_features(data[:, 0], data[:, 1]), data[:, 2])
    return lexicon


def _beside(weights: dict[str, float]):
    """Of each hit of a term in a text, the phrases with the word before and after it, and their wider context."""
    schema = pa.schema([("phrase", pa.string()), ("context", pa.int64()), ("toxic", pa.int32())])
    entire, starts = {t[1:-1] for t in weights if t.endswith("$")}, {t[1:] for t in weights if not t.endswith("$")}
    sizes = sorted({len(t) for t in starts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (part for whole in batches for part in sub_batches(whole, "text", 200_000)):
            rows = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = _WORD.findall(fold(text or ""))
                for k, word in enumerate(words):
                    if word in entire or any(word[:n] in starts for n in sizes):
                        context = xxhash.xxh64_intdigest(" ".join(words[max(0, k - 3) : k + 4])) >> 1
                        rows |= {(" ".join(words[a : a + 2]), context, toxic) for a in (k - 1, k) if 0 <= a < len(words) - 1}
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), schema)], schema=schema)

    return run


def _features(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of the sum of weights and the number of words: 1, log of the sum, log of the sum by 100 words."""
    return np.column_stack([np.ones(len(hits)), np.log1p(hits), np.log1p(100 * hits / (words + 20))])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the ridge holds the slopes only."""
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = ridge * np.array([1e-3, 1, 1])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(r), x.T @ (y - p) - r * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def _scan(lexicon: Lexicon, text_col: str = "text"):
    """A function that counts the hits of each text of a batch: sum of weights, number of hits, number of words."""
    weights, exceptions = dict(lexicon.weights), [fold(e) for e in lexicon.exceptions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, w in weights.items():
            stem, entire = term[1:].rstrip("$"), term.endswith("$")
            old = machine.get(stem, (0, 0.0, 0.0, False))
            machine.add_word(stem, (len(stem), old[1] if entire else w, w if entire else old[2], old[3]))
        for phrase in exceptions:
            old = machine.get(phrase, (0, 0.0, 0.0, False))
            machine.add_word(phrase, (len(phrase), old[1], old[2], True))
        if len(machine):
            machine.make_automaton()
        for whole in batches:
            for batch in sub_batches(whole, text_col):
                out = np.zeros((batch.num_rows, 3))
                for k, text in enumerate(batch.column(text_col).to_pylist()):
                    if not text:
                        continue
                    out[k, 2] = text.count(" ") + text.count("\n") + 1
                    if not len(machine):
                        continue
                    folded = fold(text)
                    best: dict[int, float] = {}
                    excused: list[tuple[int, int]] = []
                    for end, (n, start_weight, word_weight, exception) in machine.iter(folded):
                        a, b = end - n + 1, end + 1
                        if a and folded[a - 1].isalnum():
                            continue
                        ends = b == len(folded) or not folded[b].isalnum()
                        if exception and ends:
                            excused.append((a, b))
                        w = max(start_weight, word_weight if ends else 0.0)
                        if w > 0:
                            best[a] = max(w, best.get(a, 0.0))
                    for a, b in excused:
                        best = {s: w for s, w in best.items() if not a <= s < b}
                    out[k, :2] = sum(best.values()), len(best)
                yield batch, out

    return run


def _with_label(scan):
    schema = pa.schema([("hits", pa.float64()), ("words", pa.int64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in scan(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 2].astype(np.int64)), batch.column("toxic").cast(pa.int32())], schema=schema)

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text: id_col, score double (0 to 1), predicted int (score >= 0.5), n_hits long, density double.

    Null and empty texts have no hits and get the score of a text without hits. density is the sum of weights by 100
    words. With an empty lexicon every score is that of no hits. Ids may have any type, null too; rows that repeat have
    equal scores, very long texts are scored whole, an empty table gives an empty result, other columns are ignored.
    """
    scan = _scan(lexicon)
    coefficients = np.array(lexicon.coefficients)
    names = ["id", "score", "predicted", "n_hits", "density"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in scan(batches):
            p = 1 / (1 + np.exp(-np.clip(_features(out[:, 0], out[:, 2]) @ coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(out[:, 1].astype(np.int64)), pa.array(100 * out[:, 0] / (out[:, 2] + 20))], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, f"id {kind_of(docs, id_col)}, score double, predicted int, n_hits long, density double").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of docs that score() predicts 0 for, with all their columns, in one pass.

    Each row is judged by its text alone, null and empty ones as a text without hits; columns may have any names.
    """
    scan = _scan(lexicon, text_col)
    coefficients = np.array(lexicon.coefficients)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in scan(batches):
            yield batch.filter(pa.array(_features(out[:, 0], out[:, 2]) @ coefficients < 0))

    return in_arrow(docs, run, docs.schema)


#: Labelled rows that a lexicon is learned from, at most.
SAMPLE = 12_000


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold_out = F.pmod(crc_of("doc_id"), F.lit(5)) == 0
    lexicon = learn(labelled(docs, labels.where(~fold_out), SAMPLE))
    return score(docs, lexicon).withColumn("held_out", fold_out).select("doc_id", "held_out", "score", "predicted", "n_hits", "density")
