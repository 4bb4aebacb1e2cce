"""Settings in rows: layers, budgets, groups that must agree."""

from pyspark.sql import functions as F

from chatquarry.operators import layers


def test_layers(spark):
    rows = [
        (1, '{"t": 0.5}', '{"t": 0.1, "k": 3}'), (2, None, '{"t": "0.25", "k": "x"}'), (3, "{broken", "[1]"), (4, '{"t": null, "k": 2.0}', ""), (5, '"text"', "null"),
        (6, '{"k": {"t": 1}}', '{"k": [5]}'), (7, '{"T": 1}', '{"t": 1e1, "k": 99999999999}'), (8, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    out = layers.resolve(df, {"a": F.col("a"), "b": F.col("b")}, {"t": ("double", 9.5), "k": ("int", None)})
    got = {r.id: (r.t, r.t_from, r.k, r.k_from, tuple(r.malformed)) for r in out.collect()}
    assert got == {
        1: (0.5, "a", 3, "b", ()), 2: (0.25, "b", None, "fallback", ()), 3: (9.5, "fallback", None, "fallback", ("a", "b")), 4: (9.5, "fallback", 2, "a", ("b",)),
        5: (9.5, "fallback", None, "fallback", ("a", "b")), 6: (9.5, "fallback", None, "fallback", ()), 7: (10.0, "b", None, "fallback", ()), 8: (9.5, "fallback", None, "fallback", ()),
    }
    assert layers.resolve(df.where("false"), {"a": F.col("a")}, {"t": ("double", 1.0)}).count() == 0


def test_budgets(spark):
    df = spark.createDataFrame([("strict", None, 5), ("legacy", 7, None), ("other", None, None)], "mode string, m int, n int")
    got = df.select(layers.context_caps({"strict": (4, 4), "legacy": (20, 16)}, F.col("mode"), F.col("m"), F.col("n")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(4, 5), (7, 16), (None, None)]
    over = spark.range(1).select(layers.beyond(F.lit(10), {"a": F.lit(9), "b": F.lit(10), "c": F.lit(None).cast("int"), "d": F.lit(1)}).alias("o")).first().o
    assert over == ["a", "d"]


def test_groups_that_disagree(spark):
    rows = [("b", 1, None, ["x", "y"]), ("a", 1, 2, ["y", "x", "x"]), ("c", None, 2, []), ("d", 1, 2, None), ("e", 1, 2, ["x", "z"])]
    df = spark.createDataFrame(rows, "name string, r int, alpha int, modules array<string>")
    got = {(r.name, r.field): (r.only_first, r.only_here) for r in layers.disagreements(df, "name", ["r", "alpha"], ["modules"]).collect()}
    both = ["x", "y"]
    assert got == {("b", "alpha"): (["2"], []), ("c", "r"): (["1"], []), ("c", "modules"): (both, []), ("d", "modules"): (both, []), ("e", "modules"): (["y"], ["z"])}
    weights = spark.createDataFrame([("a", 0.3), ("a", 0.7 + 1e-9), ("b", 0.3), ("b", 0.6), ("c", None)], "k string, w double")
    assert {r.k: round(r.total, 3) for r in layers.unbalanced(weights, "k", "w").collect()} == {"b": 0.9, "c": 0.0}
