"""Counts of subword tokens by a vocabulary of merge ranks, for wherever a number of tokens is asked for."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces whose counts a task holds; a full table starts anew.
KNOWN = 200_000


def ranks_of(content: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines `base64 rank`: a token's bytes and its id."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, content.splitlines())))}


def pieces(raw: bytes, ranks: Mapping[bytes, int]) -> int:
    """How many tokens the merges leave of a byte string: of all pairs the lowest rank is merged first, the leftmost of equals.

    Pairs wait in a heap, so long strings take n log n steps.
    """
    if raw in ranks:
        return 1
    size, after, before = [1] * len(raw), list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
    rank = lambda k, n: ranks.get(raw[k : k + n])
    heap = [(r, k, 2) for k in range(len(raw) - 1) if (r := rank(k, 2)) is not None]
    heapq.heapify(heap)
    left = len(raw)
    while heap:
        _, k, n = heapq.heappop(heap)
        second = k + size[k]
        if not size[k] or second >= len(raw) or size[k] + size[second] != n:
            continue  # one of the two has been merged with another since
        size[k], size[second], left = n, 0, left - 1
        after[k] = after[second]
        if after[k] < len(raw):
            before[after[k]] = k
            if (r := rank(k, n + size[after[k]])) is not None:
                heapq.heappush(heap, (r, k, n + size[after[k]]))
        if before[k] >= 0 and (r := rank(before[k], size[before[k]] + n)) is not None:
            heapq.heappush(heap, (r, before[k], size[before[k]] + n))
    return left


def subwords(ranks: Mapping[bytes, int], pattern: str) -> Callable[[Column], Column]:
    """A column function: the number of tokens of a text, each match of `pattern` merged by itself; null is empty text.

    The vocabulary goes with the function, so it must be small; counts of short pieces are looked up once known.
    """
    if len(ranks) > 1 << 18:
        raise ValueError("the vocabulary has more than 2^18 entries")

    @F.pandas_udf(T.IntegerType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        split, known = regex.compile(pattern).findall, {}

        def one(text: str | None) -> int:
            total = 0
            for piece in split(text or ""):
                n = known.get(piece)
                if n is None:
                    n = pieces(piece.encode(), ranks)
                    if len(known) >= KNOWN:
                        known.clear()
                    if len(piece) <= 64:
                        known[piece] = n
                total += n
            return total

        for texts in batches:
            yield texts.map(one).astype("int32")

    return counted
