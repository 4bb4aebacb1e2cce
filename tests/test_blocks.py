"""Blocked tensors and matrices against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatquarry.operators import blocks


def vectors(spark, rows, kind="adapter string, name string, v array<double>"):
    return spark.createDataFrame(rows, kind).repartition(3)


def test_cut_and_join(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0]), ("b", [6.0, 7.0]), ("c", []), ("d", None)], "name string, v array<double>")
    cut = blocks.cut(df, "v", 2)
    assert sorted((r.name, r.block, r["values"]) for r in cut.collect()) == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 2, [5.0]), ("b", 0, [6.0, 7.0])]
    assert {r.name: r.v for r in blocks.join(cut, "v").collect()} == {"a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [6.0, 7.0]}


def test_weighted_sums(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 2000)  # partial sums are handed on again and again
    rng = random.Random(1)
    rows = [(rng.choice("hhhab"), rng.random(), [rng.random() for _ in range(50)]) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("a", None, [1.0] * 50)], "name string, w double, v array<double>").repartition(5)
    got = {r.name: r.v for r in blocks.join(blocks.weighted_sums(blocks.cut(df, "v", 16), "w").drop("n"), "v").collect()}
    for name in "hab":
        assert np.allclose(got[name], sum(w * np.array(v) for n, w, v in rows if n == name))
    moved = blocks.weighted_sums(blocks.cut(df, "v", 16), "w")
    assert moved.count() == 3 * 4 and set(r.n for r in moved.where("name = 'h'").collect()) == {sum(n == "h" for n, *_ in rows)}
    odd = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 0, [1.0])], "name string, block long, values array<double>")
    with pytest.raises(Exception, match="differ in size"):
        blocks.weighted_sums(odd).collect()
    assert blocks.weighted_sums(odd.where("false")).count() == 0
    null = spark.createDataFrame([("a", 0, [1.0, None])], "name string, block long, values array<double>")
    assert str(blocks.weighted_sums(null).first()["values"]) == "[1.0, nan]"


def plain_drop(values, drop, seed, key, first):
    """The same mixing, number by number."""
    import zlib

    out, mask = [], (1 << 64) - 1
    for k, v in enumerate(values):
        x = ((first + k) * 0x9E3779B97F4A7C15 + (zlib.crc32(f"{seed}|{key}".encode()) << 17 | 1)) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        x ^= x >> 31
        out.append(v / (1 - drop) if x >> 11 >= round(drop * (1 << 53)) else 0.0)
    return out


def test_merge(spark):
    rng = np.random.default_rng(4)
    tensors = {(a, n): rng.normal(size=size) for a in ("x", "y", "z") for n, size in (("q", 70), ("k", 5), ("v", 33))}
    weights = {"x": 0.2, "y": 0.3, "z": 0.5}
    cut = blocks.cut(vectors(spark, [(a, n, v.tolist()) for (a, n), v in tensors.items()]), "v", 16)
    got = {r.name: r.v for r in blocks.join(blocks.merge(cut, weights, size=16), "v").collect()}
    assert all(np.allclose(got[n], sum(w * tensors[a, n] for a, w in weights.items())) for n in "qkv")
    got = {r.name: r.v for r in blocks.join(blocks.merge(cut, weights, drop=0.4, seed=3, size=16), "v").collect()}
    for n in "qkv":
        assert np.allclose(got[n], sum(w * np.array(plain_drop(tensors[a, n], 0.4, 3, f"{a}|{n}", 0)) for a, w in weights.items()))
    share = np.mean(np.array(plain_drop(np.ones(20000), 0.4, 3, "x|q", 0)) == 0)
    assert 0.38 < share < 0.42
    for missing, told in ((cut.where("not (adapter = 'y' and name = 'k')"), "adapters differ"), (cut.unionByName(cut.where("adapter = 'x' and name = 'k'")), "adapters differ"), (cut.withColumn("adapter", F.lit("w")), "no weight for the adapter w")):
        with pytest.raises(Exception, match=told):
            blocks.merge(missing, weights, size=16).collect()
    twice = cut.where("not (adapter = 'y' and name = 'k')").unionByName(cut.where("adapter = 'x' and name = 'k'"))
    with pytest.raises(Exception, match="adapters differ"):
        blocks.merge(twice, weights, size=16).collect()
    for wrong in ({"x": 0.5}, {"x": 0.2, "y": 0.9}):
        with pytest.raises(ValueError):
            blocks.merge(cut, wrong)
    with pytest.raises(ValueError):
        blocks.merge(cut, weights, drop=1.0)


@pytest.mark.parametrize("high, wide, inner", [(4, 5, 3), (100, 100, 100), (1, 1, 1), (7, 3, 2)])
def test_fold(spark, high, wide, inner):
    rng = np.random.default_rng(high)
    w, b, a = rng.normal(size=(13, 11)), rng.normal(size=(13, 6)), rng.normal(size=(6, 11))
    frame = lambda m: spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(m)], "row long, v array<double>").repartition(3)
    base, left, right = blocks.matrix(frame(w), "row", "v", high, wide), blocks.matrix(frame(b), "row", "v", high, inner), blocks.matrix(frame(a), "row", "v", inner, wide)
    got = {r.row: r["values"] for r in blocks.matrix_rows(blocks.fold(base, left, right, 0.25), high).collect()}
    assert np.allclose([got[k] for k in range(13)], w + 0.25 * b @ a)
    with pytest.raises(Exception, match="have no product|differ in size|a product is lacking"):
        blocks.fold(base, left, blocks.matrix(frame(a[:5]), "row", "v", inner, wide), 1.0).collect()
    with pytest.raises(Exception, match="the base has no block"):
        blocks.fold(base.where("i > 0 or j > 0"), left, right, 1.0).collect()


def test_merge_leaves_out_names_that_not_all_have(spark, tmp_path):
    from chatquarry.plans import catalog

    for n in (9, 10, 12):  # the last name has one, two and four adapters
        spark.createDataFrame([(k, [float(k + i) for i in range(64)]) for k in range(n)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = {(r["name"], r.position): r.value for r in catalog.QUERIES["merged_adapters"](spark, f"{tmp_path}/{n}").collect()}
        assert got == {(str(k), i): pytest.approx(sum(w * (4 * k + a + i) for a, w in enumerate((0.1, 0.2, 0.3, 0.4)))) for k in range(n // 4) for i in range(64)}
