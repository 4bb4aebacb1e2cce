"""Alignment of two tokenizers' tokens by where they end in a text's bytes.

Python only tokenises: it gives each side's ids, where the tokens before them end, and which token holds each byte. Groups
(cut where tokens of both sides end) and links (tokens whose bytes overlap) are made by array functions and higher-order
functions from the two lists of ends, in time n log n for a text of n tokens: no lambda looks for a value in a list.
Spark interprets lambdas, so these do little for each end, and ids are written and cut as whole texts. Links of all
documents are counted by pair of ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.base import let, replace_all
from ._shared import Scratch, in_arrow, sub_batches, table

#: The query's two vocabularies, names in the package of public tokenizers.
LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What tokenize() adds.
NEW = ("a", "a_ends", "a_at", "a_sign", "b", "b_ends", "b_at", "b_sign")
#: What stands for id 0 in marks, which must have a sign.
ZERO = 2**31 - 1
#: Bytes of text that are encoded at once: their lists have a number for each byte.
TEXT_BYTES = 250_000
#: Pairs of ids that are broadcast at once with their counts; more pairs are met in several passes.
PAIRS_AT_ONCE = 1_000_000


def byte_of_char() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: printable ones as themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(file: bytes) -> dict[bytes, int]:
    """Ids by bytes of a byte-level BPE in the tokenizers format: single bytes and what merges make, no special tokens.

    Its merges must make the ids in order, so that an id is a rank; a file whose merges don't is an error.
    """
    model, of = json.loads(file)["model"], byte_of_char()
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [(a + b, vocab[a + b]) for a, b in merges]
    if model["type"] != "BPE" or any(a[1] >= b[1] for a, b in zip(made, made[1:])):
        raise ValueError("not a byte-level BPE whose merges are in the order of ids")
    return {bytes(of[c] for c in t): i for t, i in [*((c, vocab[c]) for c in of), *made]}


class Side:
    """Ids of texts by one tokenizer, and the bytes that they stand for."""

    bytes_of: list[bytes]

    def ready(self) -> None:
        self.size = np.array([len(b) for b in self.bytes_of], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.all = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of space+text for each text."""
        raise NotImplementedError

    def spread(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, ...] | None:
        """The ids, ends, ids at bytes and signs at bytes, as tokenize() gives them; None if the ids' bytes, joined, aren't raw."""
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int32)
        if len(raw) != (ends[-1] if len(ends) else 0):
            return None
        ends -= size
        held = np.repeat(self.start[ids] - ends, size) + np.arange(len(raw))
        if not (self.all[held] == np.frombuffer(raw, np.uint8)).all():
            return None
        sign = np.ones(len(raw), np.int32)
        sign[ends] = -1
        return ids, ends, np.repeat(ids, size), sign


class Left(Side):
    """A byte-level BPE; special tokens' strings are ordinary text."""

    def __init__(self, file: bytes, pattern: str):
        import tiktoken

        ranks = byte_level(file)
        self.encoder = tiktoken.Encoding("left", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.ready()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoder.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]


class Right(Side):
    """A piece model that puts a space, written U+2581, before a text."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=file)
        piece, is_byte = self.encoder.id_to_piece, self.encoder.is_byte
        self.bytes_of = [bytes([int(piece(i)[3:-1], 16)]) if is_byte(i) else piece(i).replace("\u2581", " ").encode() for i in range(self.encoder.get_piece_size())]
        self.ready()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.encoder.encode(texts, num_threads=1)]


def _lists(values: list[np.ndarray]) -> pa.Array:
    """Lists without nulls, and declared so: Spark sorts and compares such numbers unboxed."""
    starts, flat = np.cumsum([0, *map(len, values)], dtype=np.int32), np.concatenate([np.zeros(0, np.int32), *values])
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), nullable=False)))


def tokenize(docs: DataFrame, left: bytes, right: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """docs' other columns with a, a_ends, a_at, a_sign and the same of b (array<int> without nulls): each side's ids, where
    the token before each ends in space+text, for each byte the id of the token that holds it, and -1 for each byte before
    which a token ends (or none is), 1 for others.

    left is the content of a byte-level BPE's JSON file, right that of a piece model. Texts that are null, empty, or of
    which one side's bytes, joined, are not space+text have empty lists. Texts are encoded whole. The new names
    must not be columns of docs.
    """
    if len(left) + len(right) > 64 << 20:
        raise ValueError("the vocabularies have more than 64 MB")
    sent = docs.sparkSession.sparkContext.broadcast((left, right, {}))
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_file, right_file, kept = sent.value  # a worker's later tasks find what its first one has made
        a, b = kept.get("both") or kept.setdefault("both", (Left(left_file, pattern), Right(right_file)))
        for whole in batches:
            for batch in sub_batches(whole, text_col, TEXT_BYTES):
                columns: list[list[np.ndarray]] = [[] for _ in NEW]
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                for text, x, y in zip(texts, a.encode(texts), b.encode(texts)):
                    lists = a.spread(x, raw := b" " + text.encode()), b.spread(y, raw)
                    for column, value in zip(columns, (*lists[0], *lists[1]) if text and all(lists) else [np.zeros(0, np.int32)] * len(NEW)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *map(_lists, columns)], names=[*others, *NEW])

    kind = StructType(docs.select(*(F.col(f"`{c}`") for c in others)).schema.fields)
    for name in NEW:
        kind = kind.add(name, ArrayType(IntegerType(), False))
    return in_arrow(docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")), run, kind)


def align(tokens: DataFrame) -> DataFrame:
    """tokenize()'s rows with cuts, a_marks, b_marks (array<int>) and links (array<long>) in place of ends, ids and signs at bytes.

    cuts are the ends that both sides have: a group is what lies between two of them. a_marks has for each
    token of `a` its id (ZERO for 0), negative where the group begins; b_marks likewise. links has, in order, every
    pair of tokens, one of each side, whose bytes overlap, as pair_of() their ids: there is one for each stretch between
    neighbouring ends of any side, found by the tokens that hold its first byte. Texts without tokens have empty lists;
    other columns pass, of which none may be named `ends`.
    """
    # bound as arguments, so that no plan can evaluate or fetch the lists anew for each of the ends
    over = lambda ends, x, y, f: let(F.col(x), lambda x: let(F.col(y), lambda y: F.transform(ends, lambda e: f(x[e], y[e]))))
    signed = lambda own, other, f: over(f"{own}_ends", f"{own}_at", f"{other}_sign", lambda i, sign: f(i) * sign)
    no_zero = lambda i: F.when(i == 0, ZERO).otherwise(i)
    marks = lambda own, other: F.when(F.array_contains(own, 0), signed(own, other, no_zero)).otherwise(signed(own, other, lambda i: i))
    of_b_alone = let(F.col("a_sign"), lambda sign: F.filter("b_ends", lambda e: sign[e] > 0))
    out = tokens.withColumn("ends", F.sort_array(F.concat("a_ends", of_b_alone)))  # stands alone, as a lambda's argument it would be sorted boxed
    cuts = F.array_remove(F.concat(F.array_intersect("a_ends", "b_ends"), F.array(F.size("a_at"))), 0)
    new = {"cuts": cuts, "a_marks": marks("a", "b"), "b_marks": marks("b", "a"), "links": over("ends", "a_at", "b_at", pair_of)}
    return out.withColumns(new).drop("ends", *(c for c in NEW if "_" in c))


def groups(aligned: DataFrame) -> DataFrame:
    """align()'s rows with groups array<struct<a array<int>, b array<int>, end int>>: the ids of each group and where it ends."""
    first = lambda marks: F.array_remove(F.transform(marks, lambda x, i: F.when(x < 0, i + 1).otherwise(0)), 0)
    part = lambda ids, at, k: F.slice(ids, F.get(at, k), F.coalesce(F.get(at, k + 1), F.size(ids) + 1) - F.get(at, k))
    each = let(first("a_marks"), lambda x: let(first("b_marks"), lambda y: F.transform("cuts", lambda end, k: F.struct(part("a", x, k).alias("a"), part("b", y, k).alias("b"), end.alias("end")))))
    return aligned.withColumn("groups", each)


def within(text: Column, before: int, after: int) -> Column:
    """A text of ASCII without so many characters at its ends, cut as bytes: in a text Spark would count characters."""
    return F.substring(text.cast("binary"), F.lit(before + 1), F.octet_length(text) - (before + after)).cast("string")


def group_text(ids: str, text: str) -> Column:
    """The ids of each group, with a comma behind each: array<string>. text is the column of the ids' marks as JSON, like [-1,2,-3]."""
    text = F.concat(within(F.col(text), 2, 1), F.lit(","))
    return F.split(F.when(F.array_contains(ids, 0), F.replace(text, F.lit(str(ZERO)), F.lit("0"))).otherwise(text), "-")


def pair_of(a: Column, b: Column) -> Column:
    """Two ids as one number."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, count, best) over align()'s links: in how many rows a pair is linked, and whether no pair of the same `a` is in more.

    Counts are summed within each task before they are shuffled, by pairs and then by ids of the one side.
    """
    counts = linked.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = Scratch(linked.sparkSession, "pairs").keep(counts, "counts")
    of_a = F.shiftright("pair", 32).cast("int")
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))  # no more rows than ids of a vocabulary of 64 MB
    return counts.withColumn("a", of_a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, left: bytes, right: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum (all long), groups_sha256.

    n_best is how many of a row's links are of a pair that is linked in as many rows as any of its `a`; count_sum sums
    that number over its links. groups_sha256 digests `a1,a2|b1;a3|b2,b3`, the ids of each group; it is empty without
    tokens. Null and empty texts, and those whose bytes a side doesn't give back, have zeros. Rows that repeat an id
    or a text are rows of their own and count as such; ids may have any type; an empty table gives an empty result,
    other columns are ignored. Distinct pairs are broadcast `at_once` at a time, so that no list of links is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # columns that are used twice stand alone, so that they are made once
    # columns that are used twice stand alone, so that they are made once
    rows = align(tokenize(some, left, right, pattern)).withColumns({"a_text": F.to_json("a_marks"), "b_text": F.to_json("b_marks")})
    both = F.arrays_zip(group_text("a", "a_text").alias("a"), group_text("b", "b_text").alias("b"))
    rows = rows.withColumn("text", both.cast("string"))  # [{a1,a2,, b1,}, {a3,, b2,b3,}]
    text = replace_all(within(F.col("text"), 2, 3), [(",}, {", ";"), (",, ", "|")])
    size = lambda c: F.size(c).cast("long")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", size("a").alias("n_a"), size("b").alias("n_b"), (size("a") + size("b") - size("links")).alias("n_groups"), size("links").alias("n_links"),
        F.when(F.size("links") > 0, F.sha2(text.cast("binary"), 256)).otherwise("").alias("groups_sha256"), "links",
    )
    rows = scratch.keep(rows, "rows", wide=True)
    counts = scratch.keep(pair_counts(rows), "counts")
    passes = max(1, -(-counts.count() // at_once))
    turn = lambda p: F.pmod(F.xxhash64(p), F.lit(passes))
    each = rows.select("row", F.explode("links").alias("pair"))
    sums = []
    for k in range(passes):
        now = each.where(turn("pair") == k).join(F.broadcast(counts.where(turn("pair") == k)), "pair").groupBy("row")
        sums.append(scratch.keep(now.agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum")), f"sums-{k}"))
    sums = reduce(DataFrame.unionByName, sums).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("links").join(sums, "row", "left")
    none = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def _file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), _file(LEFT), _file(RIGHT), public_tokenizers.PATTERN)
