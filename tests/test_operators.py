import json
import math

import pytest
from pyspark.sql import functions as F

from chatquarry.operators import curate, monitor, normalize, report, score, vectors
from chatquarry.plans import settings
from chatquarry.sources import readers, sinks
from chatquarry.streaming import incremental, manifest


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def rows(spark, n=200):
    return spark.range(n).select("id", (F.col("id") % 7).cast("string").alias("key"))


@pytest.mark.parametrize("parts", [1, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = rows(spark).repartition(parts)
    assert ids(curate.take_seeded(df, 5, "id")) == ids(curate.take_seeded(rows(spark).coalesce(1), 5, "id"))
    assert ids(curate.cap_per_key(df, "key", 4, "id")) == ids(curate.cap_per_key(rows(spark).coalesce(1), "key", 4, "id"))
    assert sorted((r.id, r.i) for r in curate.dense_id(df, "id", "i").collect()) == [(k, k) for k in range(200)]
    assert ids(curate.split_train_eval(df, 9, "id").where("split = 'eval'")) == ids(curate.take_seeded(rows(spark).coalesce(1), 9, "id"))


def test_caps_and_dedup(spark):
    capped = curate.cap_per_key(rows(spark), "key", 4, "id").groupBy("key").count().collect()
    assert {r["count"] for r in capped} == {4}
    with pytest.raises(ValueError):
        curate.cap_per_key(rows(spark), "key", 0, "id")
    assert ids(curate.dedup_first(rows(spark), F.col("key"), "id")) == list(range(7))


def test_oversample_is_exact(spark):
    assert curate.oversample(rows(spark, 10), 35, "id").count() == 35
    assert curate.oversample(rows(spark, 10).where("id < 0"), 35, "id").count() == 0
    assert curate.oversample(rows(spark, 10), 35, "id").select("id").distinct().count() <= 10


def test_first_failing_rule_wins(spark):
    df = rows(spark, 10).withColumn("reason", curate.reason([("small", F.col("id") > 2), ("odd", F.col("id") % 2 == 0), ("unknown", F.lit(None).cast("boolean"))]))
    assert {r.reason: r.rows for r in curate.drop_counts(df).collect()} == {"small": 3, "odd": 4, "unknown": 3}


def test_aligned_raises_on_lone_rows(spark):
    a, b = rows(spark, 5).select("id"), rows(spark, 5).select("id", "key")
    assert curate.aligned(a, b, "id").count() == 5
    with pytest.raises(Exception, match="no counterpart"):
        curate.aligned(a, b.where("id < 4"), "id").collect()


def test_sizes():
    assert curate.resolve_sizes(None, None, 500) == 50_000 and curate.resolve_sizes(None, 100, 5) == 105 and curate.resolve_sizes(7, None, 5) == 7
    with pytest.raises(ValueError):
        curate.resolve_sizes(1, 1, 1)
    assert curate.small_pool(0, 6) and not curate.small_pool(10, 50)


def test_pass_at_k(spark):
    df = spark.createDataFrame([(n, c, k) for n in (4, 8) for c in range(n + 1) for k in (1, 2, 4)], "n int, c int, k int")
    for k in (1, 2, 4):
        for r in df.where(F.col("k") == k).select("n", "c", score.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect():
            assert r.p == pytest.approx(1 - math.comb(r.n - r.c, k) / math.comb(r.n, k))


def test_report_needs_uniform_problems(spark):
    df = spark.createDataFrame([(4, 1), (4, 4)], "n int, c int")
    assert score.report(df, (1, 8)).first().asDict() == {"n_problems": 2, "n_completions": 8, "pass_at_1": 0.625, "pass_at_8": None}
    for bad in (df.where("n > 9"), df.unionByName(spark.createDataFrame([(3, 1)], "n int, c int"))):
        with pytest.raises(Exception, match="differing numbers"):
            score.report(bad).collect()
    with pytest.raises(Exception, match="doesn't have 8"):
        score.mean_at_k(df, 8).collect()


def test_band_and_solve_rate(spark):
    df = spark.createDataFrame([(0.2,), (0.8,), (0.81,)], "solve_rate double")
    assert score.difficulty_band(df).count() == 2
    with pytest.raises(ValueError):
        score.difficulty_band(df, 0.9, 0.1)
    with pytest.raises(Exception, match="no rollouts"):
        spark.range(1).select(score.solve_rate(F.lit(0), F.col("id"))).collect()


def test_rollups(spark):
    facts = spark.createDataFrame([(1, True, "correct"), (1, False, "no_box"), (2, False, "strange"), (2, False, "wrong_box")], "problem_id long, is_correct boolean, failure_mode string")
    problems = spark.createDataFrame([(1, "A"), (2, ""), (3, None)], "problem_id long, subject string")
    per = report.per_problem(facts, problems)
    got = {r.problem_id: (r.n_completions, r.n_correct, r.solve_rate, r.other) for r in per.collect()}
    assert got == {1: (2, 1, 0.5, 0), 2: (2, 0, 0.0, 1), 3: (0, 0, 0.0, 0)}
    by = report.breakdown(per.join(problems, "problem_id"), ["subject"])
    assert {r.key: r.n_problems for r in by.collect()} == {"A": 1, "Unknown": 2}
    assert [r.name for r in report.weakest(by, ["A", "B", "Unknown"]).collect()] == ["B", "Unknown"]
    assert report.target_summary(per.where("false")).first().asDict()["pass_at_1"] == 0.0
    assert spark.sql("select 0 no_box, 2 wrong_box, 2 truncated, 0 repetition, 0 other").select(report.dominant()).first()[0] == "wrong_box"


def test_reward_variance(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([1.0, 1.0],)], "rewards array<double>")
    got = report.reward_variance(df).first()
    assert (got.mean_variance, got.mean_reward, got.mean_std) == (0.125, 0.75, 0.25)
    assert report.variance_passes(df).first().passed and not report.variance_passes(df, 0.2).first().passed
    with pytest.raises(Exception, match="no prompts"):
        report.variance_passes(df.where("false")).collect()
    with pytest.raises(Exception, match="under two"):
        report.reward_variance(df.unionByName(spark.createDataFrame([([1.0],)], "rewards array<double>"))).collect()


def test_normalisers(spark):
    lev = spark.createDataFrame([("p", "s \\boxed{1}", "3", "Counting and Probability", None), ("p", "s", "Level 4", None, "7"), ("p", "s", "x", "", None), (" ", "\\boxed{1}", "1", "a", None)], "problem string, solution string, level string, type string, answer string")
    got = [tuple(r) for r in normalize.leveled(lev).collect()]
    assert got == [("p", "s \\boxed{1}", "Counting & Probability", "Level 3"), ("p", "s\n\n\\boxed{7}", None, "Level 4")]
    bad = spark.createDataFrame([(None, None)], "prompt string, answer string")
    with pytest.raises(Exception, match="neither prompt"):
        normalize.either_schema(bad).collect()
    fails = spark.createDataFrame([("p", "1", 0, 4, ["a"]), ("q", "1", 1, 4, ["a"])], "prompt string, answer string, c int, n int, completions array<string>")
    assert normalize.failures(fails, "m").columns == ["prompt", "answer", "m_pass_at_n", "m_completions"] and normalize.failures(fails, "m").count() == 1


def test_completions_are_attached_uniformly(spark):
    items = spark.createDataFrame([(1, "p", "1"), (2, "q", "2")], "id long, prompt string, answer string")
    comps = spark.createDataFrame([(1, ["\\boxed{1}", "x"]), (2, ["y", "z"])], "id long, completions array<string>")
    out = normalize.attach_completions(items, comps, "id")
    assert out.columns == ["id", "prompt", "answer", "completions"] and out.count() == 2
    with pytest.raises(Exception, match="uniform"):
        normalize.attach_completions(items, comps.withColumn("completions", F.slice("completions", 1, F.col("id").cast("int"))), "id").collect()
    with pytest.raises(Exception, match="no counterpart"):
        normalize.attach_completions(items, comps.where("id = 1"), "id").collect()
    dump = normalize.teacher_rows(score.count_correct(out.withColumn("gold", F.col("answer"))))
    assert sorted((r.prompt, r.n_correct, r.n_well_formatted) for r in dump.collect()) == [("p", 1, 0), ("q", 0, 0)]
    row = normalize.distilled(spark.sql("select 3 problem_idx, 0 sample_idx, 'p' prompt, ' s ' completion, 0.5 teacher_pass_at_n"), "tag").first()
    assert row.messages[1].content == "s" and row.source == "tag" and row.problem_idx == 3
    good = spark.createDataFrame([("<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\n",)], "prompt string")
    normalize.assert_templated(good, "prompt", "prompt")
    with pytest.raises(ValueError):
        normalize.assert_templated(spark.createDataFrame([("plain",)], "prompt string"), "prompt", "prompt")


def test_vectors(spark):
    df = spark.createDataFrame([("w", 0.25, [1.0, 2.0]), ("w", 0.75, [3.0, 4.0])], "name string, weight double, v array<double>")
    assert vectors.drop_and_rescale(df, "name", "v", 0).collect() == df.collect()
    with pytest.raises(ValueError):
        vectors.check_weights([0.5, 0.6])
    vectors.check_same([{"r": 1, "m": ["a", "b"]}, {"r": 1, "m": ["b", "a"]}], ["r"], ["m"])
    with pytest.raises(ValueError):
        vectors.check_same([{"r": 1}, {"r": 2}], ["r"])


def test_settings(spark, tmp_path):
    assert settings.warmup_steps(10, 4, 1) == 1 and settings.warmup_steps(50_000, 32, 2) == 94
    (tmp_path / "g.json").write_text('{"top_k": 5}')
    assert settings.sampling({"top_p": 0.5}, settings.settings_file(spark, str(tmp_path / "g.json"))) == {"temperature": 0.3, "top_p": 0.5, "top_k": 5}
    assert settings.settings_file(spark, str(tmp_path / "none.json")) is None
    assert settings.context_caps("legacy", new_tokens=9) == (20480, 9)
    assert settings.token_budget(4096, 4096, 4096) == [] and len(settings.token_budget(9000, 8000, 4096)) == 2
    with pytest.raises(ValueError):
        settings.check_context(4096, 2048)


def test_monitor(spark):
    log = spark.createDataFrame([("r", k, 0.6 if k % 2 else None) for k in range(300)], "run string, step long, value double")
    got = monitor.rolling_signal(log, "run")
    assert {r.alert: r["count"] for r in got.groupBy("alert").count().collect()} == {"ok": 50, "warn": 50, "error": 50}
    assert spark.sql("select 99 s, 0.6 k union all select 100, 0.6 union all select 5, null").where(monitor.kl_spike(F.col("s"), F.col("k"))).count() == 1
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("final",)], "name string")
    assert monitor.latest_checkpoint(names).first().latest == "checkpoint-10"


def test_readers_and_sinks(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"prompt": "p", "answer": "1"}\n\n{broken\n{"prompt": "q", "answer": ""}\n')
    with pytest.raises(Exception, match="malformed line in .*a.jsonl"):
        readers.strict_json(spark, str(path), "validation").collect()
    assert [(r.line, r.text) for r in readers.bad_lines(spark, str(path), "validation").collect()] == [(3, "{broken")]
    good = readers.lenient_json(spark, str(path), "validation", F.col("answer") != "")
    assert [r.prompt for r in good.collect()] == ["p"]
    with pytest.raises(Exception):
        readers.strict_json(spark, str(path), "validation").collect()
    path.write_text('{"prompt": "q", "answer": ""}\n')
    with pytest.raises(Exception, match="no answer"):
        readers.strict_prompts(spark, str(path)).collect()
    with pytest.raises(ValueError):
        readers.require_columns(spark.range(1), [["a", "b"]])
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("é",)], "x string")
    assert sinks.once(df, out) and not sinks.once(df, out) and sinks.once(df, out, force=True)
    assert sinks.json_lines(df, out, single=True) == 1 and spark.read.json(out).first().x == "é"
    sinks.document(spark, {"a": "é"}, str(tmp_path / "d/doc.json"))
    assert sinks.document_at(spark, str(tmp_path / "d/doc.json")) == {"a": "é"} and sinks.document_at(spark, str(tmp_path / "d/none.json")) is None
    assert json.loads((tmp_path / "d/doc.json").read_text()) == {"a": "é"}


def test_streams_resume(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    log = spark.createDataFrame([("r", k, 0.6) for k in range(120)], "run string, step long, value double").coalesce(1)
    log.where("step < 60").write.mode("append").parquet(src)
    step = lambda b: b.select("step")
    incremental.process(incremental.chunks(spark, src, "run string, step long, value double", 1, "parquet"), step, out, state)
    log.where("step >= 60").write.mode("append").parquet(src)
    incremental.process(incremental.chunks(spark, src, "run string, step long, value double", 1, "parquet"), step, out, state)
    got = manifest.committed(spark, out, "step long")
    assert ids(got, "step") == list(range(120)) and got.select("chunk").distinct().count() == 2


def test_summaries():
    from datetime import datetime

    from chatquarry.plans import summaries

    assert summaries.line("math", {"n_problems": 2, "n_completions": 8, "pass_at_1": 0.5}) == "math: n_problems=2 n_completions=8 pass_at_1=0.5000"
    assert "B" in summaries.table([{"key": "A", "n_problems": 1, "pass_at_1": 1.0, "pass_at_n": 1.0}], ["A", "B"]).splitlines()[1]
    assert summaries.progress(1, 0, 0, 0) == "chunk 1: 0 attempts, 0 correct (0.0%), 0 kept"
    assert summaries.run_name("x", datetime(2024, 1, 2, 3, 4, 5)) == "x-20240102-030405"


def test_first_rows_beyond_one_task(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("id")).repartition(7)
    want = [ids(curate.take_first(df, n, "id"), "id") for n in (1, 2999, 9000)], ids(curate.take_seeded(df, 777, "id"), "id")
    monkeypatch.setattr(curate, "ONE_TASK", 0)
    assert ([ids(curate.take_first(df, n, "id"), "id") for n in (1, 2999, 9000)], ids(curate.take_seeded(df, 777, "id"), "id")) == want
    assert want[0][1] == sorted(k * 37 % 5003 for k in range(5000))[:2999]


def test_too_few_rows_for_eval(spark):
    assert curate.split_train_eval(spark.range(3), 3, "id").where("split = 'eval'").count() == 3
    with pytest.raises(Exception, match="4 rows for eval"):
        curate.split_train_eval(spark.range(3), 4, "id").collect()


def test_nulls_in_json_lines(spark, tmp_path):
    sinks.json_lines(spark.sql("select 1 a, cast(null as string) b"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":null}']
