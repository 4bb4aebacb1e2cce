"""Reward functions of Python, and running totals in stretches."""

import pytest
from pyspark.sql import functions as F

from chatquarry.functions import answers, boxed, udfs
from chatquarry.operators import curate
from chatquarry.plans import catalog


def test_reward_functions(spark):
    rows = [(k, "x" * (k % 7) if k % 5 else None, k * 2) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, other long").repartition(3)

    def make():
        calls = []

        def f(completions, other, **_):
            calls.append(sum(len(c or "") for c in completions))
            assert calls[-1] <= 20
            return [len(c or "") + o for c, o in zip(completions, other, strict=True)]

        return f

    got = {r.id: r.reward for r in udfs.rewarded(df, make, "c", ["other"], call_bytes=20).collect()}
    assert got == {k: float(len(c or "") + o) for k, c, o in rows}
    assert udfs.rewarded(df.where("false"), make, "c", ["other"]).count() == 0
    with pytest.raises(Exception, match="0 rewards for"):
        udfs.rewarded(df, lambda: lambda cs: [], "c").collect()


def test_running_totals(spark):
    df = spark.range(0, 500, 3).select("id", (F.col("id") % 11).alias("a"), F.lit(1).alias("b")).repartition(4)
    got = {r.id: (r.a, r.b) for r in curate.running_totals(df, "id", ["a", "b"], 20).collect()}
    assert got == {k: (sum(x % 11 for x in range(0, k + 1, 3)), k // 3 + 1) for k in range(0, 500, 3)}


def test_plain_boxes_are_read_as_any(spark):
    texts = [r"\boxed{1}", r"a \boxed{} b", r"\boxed{1} \boxed{x{2}}", r"\boxed{{3}}", r"\boxed{4", r"\boxed {5}", r"\fbox{6} {7}", "{8}", "", None, r"\boxed{9}}", "\\boxed{1\n2}", r"\boxed{1}\boxed", r"\fbox{1}\boxed{ 2 } tail"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*[boxed.score_answer(F.col("t"), p) for p in (True, False)], *[boxed._any_answer(F.col("t"), p) for p in (True, False)]).collect()
    assert [r[:2] for r in got] == [r[2:] for r in got] and [r[0] for r in got][:4] == ["1", "", "x{2}", "3"]


def test_numbers_are_settled_without_normal_forms(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    spark.createDataFrame([(k, k % 3, "1-URGENT") for k in range(20)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{root}/orders.parquet")
    rows = [(k, n, 7 * k + n, 1, 2.0, "x", float(3 * k + n)) for k in range(20) for n in range(1 + k % 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string, l_quantity double").write.parquet(f"{root}/lineitem.parquet")
    monkeypatch.setattr(answers, "equivalent", lambda a, b: F.raise_error(F.lit("normal forms of numbers")).cast("boolean"))
    plain, full = {}, {}
    for k, n, part, *_, q in rows:
        right = part % 11 != 0 and int(q) % 5 == k % 5
        long = len(f"<think>\nline {n}\n</think>\n\n") + 9
        plain.setdefault(k, []).append(right + 0.05 * (part % 11 != 0))
        full[k, n] = plain[k][-1] + right * 0.1 * (1 - -(-long // 4) / 64)
    got = {(r.problem_id, r.completion_idx): r.reward for r in catalog.QUERIES["reward_per_completion"](spark, root).collect()}
    assert got == {x: pytest.approx(v, abs=1e-6) for x, v in full.items()}
    two = [v if len(v) > 1 else [*v, 0.0] for v in plain.values()]
    mean = [sum(v) / len(v) for v in two]
    spread = sum(sum((x - m) ** 2 for x in v) / len(v) for v, m in zip(two, mean)) / 20
    got = catalog.QUERIES["reward_variance"](spark, root).first()
    assert got.n_prompts == 20 and got.mean_variance == pytest.approx(spread, abs=1e-6) and got.mean_reward == pytest.approx(sum(mean) / 20, abs=1e-6)
    got = catalog.QUERIES["variance_check"](spark, root).first()
    assert got.passed == (spread >= 0.01) and got.mean_variance == pytest.approx(spread, abs=1e-6)
