"""Byte-level BPE by prefix dynamic programming: each byte prefix's unique valid last token, exact appends, local re-encoding.

The merges of a vocabulary of ranks give every byte string one encoding, whose last token T has two properties: the
encoding without T is that of the string without T's bytes, and T is left alone next to the token before it. For each
prefix exactly one token has both, so a table of the last tokens, one for every byte, is filled from left to right
in linear time; the encoding is read from its end. What is appended only lengthens the table, and behind an edit the
table is what it was from where it agrees for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import in_arrow, kind_of, sub_batches, table

#: The vocabulary of the query, a name in the package of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of each of a task's tables of known words, prefixes and pairs of tokens; a full table starts anew.
KNOWN = 300_000
#: Above all ranks.
NEVER = 1 << 60
#: Bytes up to which a match's prefixes are stored for the matches that begin alike.
SHORT = 64
#: A match of the pattern depends on so many characters behind its end at most: on two for "'re", and for the white space
#: that is left to the next word, on that and on the word's first letter.
AHEAD = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines `base64 rank`: a token's bytes and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def pack(i: int) -> bytes:
    """An id as four bytes: lists of ids are then joined, cut and compared as byte strings."""
    return i.to_bytes(4, "little")


class Prefixes:
    """The table of last tokens for byte strings, and what follows from it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.packed = {b: pack(i) for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        ends: dict[bytes, set[int]] = {}
        for b in ranks:
            if len(b) > 1:
                ends.setdefault(b[-3:], {2} if b[-2:] in ranks else set()).add(len(b))
        self.lengths = {e: sorted(ns, reverse=True) for e, ns in ends.items()}  # of the tokens that end in three bytes, or are two
        self.filled = 0
        self.stored: dict[bytes, bytes] = {}
        self.stays: dict[bytes, bool] = {}
        self.alone: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]] | None] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The encoding of a short string by merging step by step, the lowest rank first, the leftmost of equals."""
        parts, ranks = [raw[k : k + 1] for k in range(len(raw))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """What stands at one edge of a token's bytes while it is merged: each part and the rank at which it is used up.

        None if merges don't reach the token, or reach it from parts of higher rank.
        """
        if (token, right) in self.edges:
            return self.edges[token, right]
        raw, found = self.bytes_of[token], [(self.bytes_of[token], NEVER)]
        if len(raw) > 1:
            two, found = self.halves(raw), None
            inner = two and max(self.ranks[p] for p in two) < token and self.edge(self.ranks[two[right]], right)
            if inner:
                found = [*inner[:-1], (inner[-1][0], token), (raw, NEVER)]
        self.edges[token, right] = found
        return found

    def halves(self, raw: bytes) -> list[bytes] | None:
        """The two parts of the last merge that gives a whole string; None if the merges end in more parts."""
        parts, ranks = [raw[k : k + 1] for k in range(len(raw))], self.ranks
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == NEVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay(self, a: int, b: int) -> bool:
        """Whether two tokens next to each other are the encoding of their bytes: no merge reaches over their border.

        The parts at the border are gone through in the order in which they are used up; one over the border comes
        about if its rank is below those at which its two parts are used up, of equals the one further left.
        """
        left, right = self.edge(a, True), self.edge(b, False)
        if left is None or right is None:
            good = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        else:
            i = j = 0
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                rank = self.ranks.get(x + y, NEVER)
                if good := not (rank < until_x and rank <= until_y):
                    if until_x == until_y == NEVER:
                        break
                    i, j = (i + 1, j) if until_x <= until_y else (i, j + 1)
                else:
                    break
        return good

    def next_to(self, pair: bytes) -> bool:
        """stay() of two packed ids, stored."""
        if len(self.stays) >= KNOWN:
            self.stays.clear()
        good = self.stays[pair] = self.stay(int.from_bytes(pair[:4], "little"), int.from_bytes(pair[4:], "little"))
        return good

    def first(self, a: int) -> bool:
        """Whether a token is the encoding of its bytes; merges don't reach every entry of every vocabulary."""
        if (found := self.alone.get(a)) is None:
            found = self.alone[a] = self.edge(a, True) is not None or self.merged(self.bytes_of[a]) == [a]
        return found

    def grow(self, raw: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Fills the table of raw's prefixes, last[k] for the first k + 1 bytes, up to a length."""
        ranks, packed, lengths, stays, end = self.ranks, self.packed, self.lengths, self.stays, len(raw) if until is None else until
        self.filled += max(0, end - len(last))
        for i in range(len(last) + 1, end + 1):
            for n in lengths.get(raw[max(0, i - 3) : i]) or lengths.get(raw[i - 2 : i], ()) if i > 1 else (1,):
                if n > i or (token := ranks.get(raw[i - n : i])) is None:
                    continue
                if n == i:
                    if self.first(token):
                        break
                else:
                    pair = pack(last[i - n - 1]) + packed[raw[i - n : i]]
                    if (good := stays.get(pair)) is None:
                        good = self.next_to(pair)
                    if good:
                        break
            else:
                token = ranks[raw[i - 1 : i]]  # a single byte, whose two last bytes are no token's
            last.append(token)
        return last

    def read(self, raw: bytes, last: list[int]) -> list[int]:
        """The ids of a whole string from its table. One that is an entry itself is that entry, whatever the merges reach."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        out, i, bytes_of = [], len(raw), self.bytes_of
        while i:
            out.append(last[i - 1])
            i -= len(bytes_of[last[i - 1]])
        return out[::-1]

    def short(self, raw: bytes) -> bytes:
        """The packed encoding of a short string; its last four bytes are the last token, found by grow()'s rule.

        Of its prefixes only those that matter are asked. Words that begin alike share what is stored for these.
        """
        if (found := self.stored.get(raw)) is not None:
            return found
        size, packed, stays = len(raw), self.packed, self.stays
        for n in self.lengths.get(raw[-3:]) or self.lengths.get(raw[-2:], ()) if size > 1 else (1,):
            if n > size or (token := packed.get(raw[size - n :])) is None:
                continue
            if n == size:
                if self.first(self.ranks[raw]):
                    found = token
                    break
            else:
                before = self.short(raw[: size - n])
                pair = before[-4:] + token
                if (good := stays.get(pair)) is None:
                    good = self.next_to(pair)
                if good:
                    found = before + token
                    break
        else:
            found = self.short(raw[:-1]) + packed[raw[-1:]]
        if len(self.stored) >= KNOWN:
            self.stored.clear()
        self.stored[raw] = found
        return found

    def encode(self, raw: bytes) -> bytes:
        """The packed encoding of a whole string. One that is an entry itself is that entry, whatever the merges reach."""
        if (whole := self.packed.get(raw)) is not None:
            return whole
        return self.short(raw) if len(raw) <= SHORT else b"".join(map(pack, self.read(raw, self.grow(raw, []))))

    def regrow(self, raw: bytes, old: list[int], start: int, tail: int) -> list[int]:
        """The table of raw, whose first `start` and last `tail` bytes are those of the string with the table `old`."""
        last, same, shift = old[:start], 0, len(old) - len(raw)
        clear = len(raw) - tail + self.longest  # tokens that end behind it hold bytes of the tail alone
        while len(last) < len(raw):
            self.grow(raw, last, len(last) + 1)
            k = len(last) - 1
            same = same + 1 if k >= clear and last[k] == old[k + shift] else 0
            if same >= self.longest:
                last += old[k + shift + 1 :]
        return last


_CUT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f\x85]")


def words_of(text: str) -> list[str]:
    """A text cut before white space that follows something else.

    Texts with other white space than space, tab and line ends, whose class differs between libraries, stay whole.
    """
    return [text] if _OTHER_SPACE.search(text) else _CUT.findall(text)


class Words(dict):
    """Splits texts by the pattern and encodes each match; words by their packed ids, for the words known.

    A match never holds white space behind anything else and looks no further than the white space's end, so the
    words of words_of() are encoded each by itself, and known ones are looked up.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.prefixes, self.pattern = Prefixes(ranks), regex.compile(pattern)

    def __missing__(self, word: str) -> bytes:
        encode, pieces = self.prefixes.encode, self.pattern.findall(word)
        out = encode(word.encode()) if len(pieces) == 1 else b"".join([encode(p.encode()) for p in pieces])
        if len(self) >= KNOWN:
            self.clear()
        if len(word) <= 100:
            self[word] = out
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words_of(text))), "<i4")

    def read(self, text: str, cuts: list[int], last: list[int]) -> list[int]:
        """The ids of a text from the tables of its matches, which end at cuts."""
        out, at, a = [], 0, 0
        for b in cuts:
            raw = text[a:b].encode()
            out += self.prefixes.read(raw, last[at : at + len(raw)])
            at, a = at + len(raw), b
        return out


def _words(sent, pattern: str) -> Words:
    ranks, kept = sent.value
    if pattern not in kept:
        kept[pattern] = Words(ranks, pattern)
    return kept[pattern]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values]), pa.int32()))


def _sent(spark: SparkSession, ranks: dict[bytes, int]):
    """The vocabulary, sent once to each executor: entries are few and short, 2^20 and 64 MB at most.

    With it goes an empty dictionary, in which a worker's later tasks find the tables of its earlier ones.
    """
    if len(ranks) > 1 << 20 or sum(map(len, ranks)) > 64 << 20:
        raise ValueError("the vocabulary has more than 2^20 entries or 64 MB")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
    return spark.sparkContext.broadcast((ranks, {}))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """Encodes whole texts: id_col, ids array<int>; with `prefixes` also text, cuts array<int>, last array<int>.

    Each match of the pattern (which must cover a text, look only ahead, and hold no white space behind anything else)
    is encoded by itself. cuts has the matches' ends in code points, last the last token of each byte prefix of its
    match: with them reencode() applies edits. Null is empty text, which has no ids; special tokens' strings are
    ordinary text. Each row is encoded alone, so rows that repeat have equal results; ids may have any type, null
    too; texts of any length take linear time. An empty table gives an empty result; other columns are ignored.
    """
    sent = _sent(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(sent, pattern)
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                texts = batch.column("text").to_pylist()
                columns = [batch.column("id"), _lists([words.ids(t) for t in texts])]
                if prefixes:
                    pieces = [words.pattern.findall(t) for t in texts]
                    columns += [batch.column("text"), _lists([np.cumsum([len(p) for p in x], dtype=np.int32) for x in pieces]), _lists([np.fromiter(chain.from_iterable(words.prefixes.grow(p.encode(), []) for p in x), np.int32) for x in pieces])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "text", "cuts", "last"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    more = ", text string, cuts array<int>, last array<int>" if prefixes else ""
    return in_arrow(rows, run, f"id {kind_of(docs, id_col)}, ids array<int>{more}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col binary: the bytes of ids_col's tokens (array<int>), joined. Null is no ids; an unknown id is an error.

    Other columns pass; ids_col itself stays. out_col must not be a column yet.
    """
    sent = _sent(encoded.sparkSession, ranks)
    kind = ", ".join(f"`{c}` {k}" for c, k in encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {i: b for b, i in sent.value[0].items()}
        size = np.zeros(max(of) + 1, np.int64)
        size[list(of)] = [len(b) for b in of.values()]
        start = np.cumsum(size) - size
        all_ = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)
        for batch in batches:
            lists = batch.column(ids_col)
            edges = lists.offsets.to_numpy()
            ids = lists.values.to_numpy()[edges[0] : edges[-1]]
            if len(ids) and not (0 <= ids.min() and ids.max() < len(size) and size[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            ends = np.cumsum(size[ids])
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - ends + size[ids], size[ids])
            bounds = np.concatenate([[0], ends])[edges - edges[0]]
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(all_[at])])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], names=[*batch.schema.names, out_col])

    return in_arrow(encoded, run, f"{kind}, `{out_col}` binary")


def edited(words: Words, text: str, cuts: list[int], last: list[int], start: int, stop: int, new: str) -> tuple[list[int], str, list[int], list[int], int]:
    """After text[start:stop] became `new`: ids, text, cuts, last, and the number of bytes whose last token was filled in."""
    prefixes, size = words.prefixes, lambda t: len(t.encode())
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    out, grown = text[:start] + new + text[stop:], len(new) - (stop - start)
    kept = next((k for k, c in enumerate(cuts) if c + AHEAD > start), len(cuts))
    at, old, fresh, behind = cuts[kept - 1] if kept else 0, {c: k for k, c in enumerate(cuts)}, [], len(cuts)
    for m in words.pattern.finditer(out, at):
        fresh.append(m.group())
        if m.end() - grown >= stop and (k := old.get(m.end() - grown)) is not None:
            behind = k + 1  # from here on the old text's matches are the new one's
            break
    tail = cuts[behind - 1] if behind else 0
    head_bytes, tail_bytes = size(text[:at]), size(text[tail:])
    now, filled = [], prefixes.filled
    for k, piece in enumerate(fresh):
        raw, before = piece.encode(), []
        if k == 0 and kept < len(cuts):
            before = last[head_bytes : head_bytes + size(text[at : cuts[kept]])]
        same = min(size(text[at:start]), len(before), len(raw))
        if len(fresh) == 1 and behind == kept + 1:
            now.append(prefixes.regrow(raw, before, same, min(size(text[stop:tail]), len(raw) - same, len(before) - same)))
        else:
            now.append(prefixes.grow(raw, before[:same]))
    tables = last[:head_bytes] + list(chain.from_iterable(now)) + (last[len(last) - tail_bytes :] if tail_bytes else [])
    ends = np.cumsum([at, *map(len, fresh)])[1:].tolist()
    new_cuts = cuts[:kept] + ends + [c + grown for c in cuts[behind:]]
    return words.read(out, new_cuts, tables), out, new_cuts, tables, prefixes.filled - filled


def reencode(encoded: DataFrame, edits: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Applies edits to rows of encode(..., prefixes=True): id_col, ids, text, cuts, last, redone int.

    edits has a row for each id: id_col, start and stop (code points of the old text; past its end, they are its end)
    and text, which stands in place of what is between; an append has start = stop = the old length. Rows of `encoded`
    without an edit pass as they are, those without an id too; an edit without a row is ignored, several edits of one
    id are an error. Only matches near the edit are split anew, and of the first of them only the bytes whose last
    token can differ are filled in; redone is the number of bytes filled. The result equals that of encode() of
    the new text. A null text of an edit is empty; an empty table on either side changes nothing.
    """
    sent = _sent(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(sent, pattern)
        for batch in (b for whole in batches for b in sub_batches(whole, "text")):
            rows = []
            for r in batch.to_pylist():
                if (r["n"] or 0) > 1:
                    raise ValueError(f"{r['n']} edits of one id: {r['id']}")
                same = (r["ids"], r["text"], r["cuts"], r["last"], 0)
                rows.append(edited(words, *same[1:4], r["start"], r["stop"], r["new"]) if r["n"] else same)
            ids, texts, cuts, last, redone = zip(*rows)
            ints = lambda lists: _lists([np.array(x, np.int32) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column("id"), ints(ids), pa.array(texts, pa.string()), ints(cuts), ints(last), pa.array(redone, pa.int32())], names=["id", "ids", "text", "cuts", "last", "redone"])

    one = edits.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.first("start").cast("int").alias("start"), F.first("stop").cast("int").alias("stop"), F.first(F.coalesce("text", F.lit(""))).alias("new"))
    rows = encoded.select(F.col(id_col).alias("id"), "ids", "text", "cuts", "last").join(one, "id", "left")
    return in_arrow(rows, run, f"id {kind_of(encoded, id_col)}, ids array<int>, text string, cuts array<int>, last array<int>, redone int").withColumnRenamed("id", id_col)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path(VOCABULARY))
    out = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
