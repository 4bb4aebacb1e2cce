"""Subword counts against a library and a plain merge, first mismatches against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from chatquarry.functions import chat, differ, subwords
from chatquarry.operators import score
from chatquarry.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plain_pieces(raw, ranks):
    parts = [raw[k : k + 1] for k in range(len(raw))]
    if raw in ranks:
        return 1
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return len(parts)


def test_pieces_of_small_vocabularies():
    rng = random.Random(1)
    for _ in range(100):
        ranks, made = {bytes([c]): c for c in range(256)}, [b"a", b"b", b"c"]
        while len(ranks) < 256 + rng.randrange(2, 25):
            x = rng.choice(made) + rng.choice(made)
            if x not in ranks and len(x) < 8:
                ranks[x] = len(ranks)
                made.append(x)
        for _ in range(30):
            raw = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40)))
            assert subwords.pieces(raw, ranks) == plain_pieces(raw, ranks)


@pytest.fixture(scope="module")
def public():
    p, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = subwords.ranks_of(f.read())
    return ranks, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_all_documents(spark, public):
    ranks, pattern, reference = public
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").unionByName(spark.createDataFrame([(None,), ("",), ("x" * 20000,), (" \n\t 's 'll été 日本 🎉" * 30,)], "text string"))
    count = subwords.subwords(ranks, pattern)
    rows = docs.select("text", count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(reference.encode_ordinary(r.text or "")) for r in rows)
    kept = {r.doc_id: r.tokens for r in catalog.QUERIES["subword_filter"](spark, FOLDER).collect()}
    assert kept and max(kept.values()) <= 1000
    one = spark.createDataFrame([("so \\boxed{4}",)], "c string").withColumn("n", count(F.col("c")))
    n = len(reference.encode_ordinary("so \\boxed{4}"))
    assert abs(one.select(score.reward(F.col("c"), F.lit("4"), F.col("n"), 0.1, 32)).first()[0] - (score.CORRECT + score.FORMAT + 0.1 * (1 - n / 64))) < 1e-9


def test_first_mismatches(spark):
    rng = random.Random(3)
    rows = [("", ""), ("", "a"), ("abc", "abc"), ("abc", "ab"), ("é日🎉x", "é日🎉y"), (None, None), (None, "a"), ("a", None), ("a" * 300, "a" * 299 + "b"), ("x" + "a" * 300, "y" + "a" * 300)]
    for _ in range(200):
        a = "".join(rng.choice("ab🎉é") for _ in range(rng.randrange(200)))
        k = rng.randrange(len(a) + 1)
        rows.append((a, a[:k] + rng.choice(["", "z", "ab"]) + a[k + rng.randrange(3) :]))
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string").select("k", differ.first_mismatch(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        a, b = rows[r.k]
        if a == b:
            assert r.m is None
            continue
        x, y = a or "", b or ""
        p = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
        kind = "null" if a is None or b is None else "length" if p == min(len(x), len(y)) else "character"
        assert (r.m.place, r.m.kind, r.m.left, r.m.right) == (p, kind, x[max(0, p - 40) : p + 80], y[max(0, p - 40) : p + 80])
    plan = spark.range(1).select(differ.first_mismatch(chat.generation_prompt(F.lit("a")), F.lit("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
