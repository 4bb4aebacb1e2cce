"""The few functions without a built-in counterpart, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repeats(text: Column, window: int = 100, times: int = 3) -> Column:
    """Some stretch of `window` characters occurs `times` times or more; overlaps count, texts under window * times don't.

    Stretches are found by a rolling hash over the whole text at once and compared as text before they count.
    """

    @F.pandas_udf(T.BooleanType())
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        base = 0x9E3779B97F4A7C15
        powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

        def grow(n: int) -> None:
            if len(powers["up"]) < n:
                for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
                    x = np.full(1 << n.bit_length(), b, np.uint64)
                    x[0] = 1
                    powers[name] = np.multiply.accumulate(x)

        def one(t: str | None) -> bool:
            if t is None or len(t) < window * times:
                return False
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            grow(len(codes) + 1)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) * powers["up"][: len(codes)], out=sums[1:])
            n = len(codes) - window + 1
            hashes = (sums[window:] - sums[:-window]) * powers["down"][:n]
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            same = np.flatnonzero(ranked[times - 1 :] == ranked[: n - times + 1])
            for k in same.tolist():  # equal hashes are equal texts but for a chance of about 2**-64
                parts = [t[i : i + window] for i in order[k : k + times].tolist()]
                if all(p == parts[0] for p in parts[1:]):
                    return True
            return False

        with np.errstate(over="ignore"):
            for batch in texts:
                yield batch.map(one).astype(bool)

    return found(text)


def casefold(text: Column) -> Column:
    """Full Unicode case folding; lower() differs on letters such as the German sharp s."""

    @F.pandas_udf(T.StringType())
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.casefold())

    return folded(text)


def exact_aliases(gold: Column) -> Column:
    """Gold answers with JSON scalars spelt as Python spells them (1e3 as 1000.0, true as True, null as None)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parsed(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str] | None:
            if x is None:
                return None
            try:
                value = json.loads(x)
            except ValueError:
                return [x]
            return [str(v) for v in value] if isinstance(value, list) else [str(value)]

        return s.map(one)

    return parsed(gold)


def tokens(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A column function from a tokenizer's batch counter, for wherever token_estimate() stands by default."""

    @F.pandas_udf(T.IntegerType())
    def counted(s: pd.Series) -> pd.Series:
        return pd.Series(count(["" if x is None else x for x in s]))

    return counted


#: Bytes of the texts that a reward function is called with at once; a longer text comes alone.
CALL_BYTES = 4 << 20


def rewarded(df: DataFrame, make: Callable[[], Callable[..., list[float]]], completion: str, columns: Sequence[str] = (), name: str = "reward", call_bytes: int = CALL_BYTES) -> DataFrame:
    """df with a double from a reward function of Python: f(completions, **columns) -> one number for each completion.

    make() returns the function; it is called once a task, for what is costly to set up. Columns are lists, by name.
    Calls are bounded by the bytes of their completions, so that long texts don't come thousands at a time. A call
    that returns another number of values is an error. `name` must not be a column of df.
    """
    kind = ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            texts = batch.column(completion)
            size = np.nan_to_num(np.array(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.float64))
            start, total = 0, 0.0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or (i > start and total + size[i] > call_bytes):
                    some = batch.slice(start, i - start)
                    if some.num_rows:
                        got = f(some.column(completion).to_pylist(), **{c: some.column(c).to_pylist() for c in columns})
                        if len(got) != some.num_rows:
                            raise ValueError(f"{len(got)} rewards for {some.num_rows} completions")
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(got, pa.float64())], names=[*some.schema.names, name])
                    start, total = i, 0.0
                if i < batch.num_rows:
                    total += size[i]

    return df.mapInArrow(run, kind)
