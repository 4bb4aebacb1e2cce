"""Manifests, progress rows and the monitor for late rows: runs that are killed and go on."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chatquarry.operators import monitor
from chatquarry.streaming import incremental, manifest, progress

KIND = "id long, x string"


def test_a_run_killed_between_data_and_manifest(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda k: spark.range(k * 10, k * 10 + 10).select("id", F.concat(F.lit("x"), "id").alias("x"))

    def killed():
        raise RuntimeError("killed")

    assert manifest.committed(spark, out, KIND).count() == 0
    assert manifest.commit(rows(0), out, 0)
    with pytest.raises(RuntimeError):
        manifest.commit(rows(1), out, 1, killed)
    assert sorted(r.id for r in manifest.committed(spark, out, KIND).collect()) == list(range(10))  # not seen early
    assert manifest.commit(rows(1), out, 1) and not manifest.commit(rows(1), out, 1)  # not twice
    seen = manifest.committed(spark, out, KIND)
    assert sorted((r.chunk, r.id) for r in seen.collect()) == [(k // 10, k) for k in range(20)]
    assert [(m["chunk"], m["rows"]) for m in manifest.chunks(spark, out)] == [(0, 10), (1, 10)]
    assert manifest.unsound(spark, out, KIND).count() == 0
    path = manifest.chunks(spark, out)[1]["path"]
    rows(5).where("id < 53").coalesce(1).write.mode("append").parquet(path)
    assert [tuple(r) for r in manifest.unsound(spark, out, KIND).collect()] == [(1, 10, 13, False)]


def test_a_stream_killed_and_resumed(spark, tmp_path):
    root, broken = str(tmp_path), {"at": 2}
    for k in range(6):
        spark.range(k * 5, k * 5 + 5).coalesce(1).write.mode("append").parquet(f"{root}/in")
        time.sleep(0.02)

    def step(batch):
        if broken["at"] == 0:
            broken["at"] = -1
            raise RuntimeError("killed")
        broken["at"] -= 1
        return batch.withColumn("twice", F.col("id") * 2)

    run = lambda: incremental.process(incremental.chunks(spark, f"{root}/in", "id long", 1, "parquet"), step, f"{root}/out", f"{root}/state")
    with pytest.raises(Exception, match="killed"):
        run()
    assert manifest.committed(spark, f"{root}/out", "id long, twice long").count() == 10
    run()
    got = manifest.committed(spark, f"{root}/out", "id long, twice long").collect()
    assert sorted((r.id, r.twice) for r in got) == [(k, 2 * k) for k in range(30)] and {r.chunk for r in got} == set(range(6))


def test_late_rows_and_progress(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", incremental.ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    rng, root = random.Random(2), str(tmp_path)
    log = [(r, k, None if rng.random() < 0.1 else rng.random() * 1.2) for r in ("a", "b", "c") for k in range(300)]
    late = {(r, k) for r, k, _ in log if k < 20 and rng.random() < 0.3}
    parts = [[] for _ in range(5)]
    for r, k, v in log:
        parts[4 if (r, k) in late else min(3, (k + rng.randrange(20)) // 75)].append((r, 1000 + k, k, v))
    parts.append([("d", 90000, 89000, None)])
    kind, name = "run string, ts long, step long, value double", "late"
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, kind).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = incremental.chunks(own, f"{root}/in", "run string, ts timestamp, step long, value double", 10, "parquet")
        writer = incremental.rolling_signal(stream, "150 seconds").writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True)
        progress.watched(own, f"{root}/progress", f"{name}{k}", lambda n: writer.queryName(n).start())
        if k == 1:  # rows that the watermark hasn't passed are held back
            assert spark.read.schema("run string, step long").parquet(f"{root}/out").agg(F.max("step")).first()[0] in (None, *range(20))
    want = monitor.rolling_signal(spark.createDataFrame([x for x in log if x[:2] not in late], "run string, step long, value double"), "run")
    key = lambda r: (r.run, r.step, round(r.rolling_mean, 9), r.alert)
    assert sorted(map(key, spark.read.parquet(f"{root}/out").collect())) == sorted(map(key, want.collect()))
    seen = progress.rows(spark, f"{root}/progress")
    assert seen.agg(F.sum("late_rows")).first()[0] == len(late) > 5
    assert seen.agg(F.sum("input_rows")).first()[0] == len(log) + 1


def test_a_stream_takes_no_more_batches_for_more_problems(spark, tmp_path, monkeypatch):
    from chatquarry.plans import catalog

    root, commits = str(tmp_path), []
    spark.range(0, 12000, 2).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{root}/orders.parquet")
    lines = spark.range(12000).select((F.col("id") - F.col("id") % 2).alias("l_orderkey"), (F.col("id") % 2).cast("int").alias("l_linenumber"), (F.col("id") % 23).alias("l_partkey"), F.lit(1).alias("l_suppkey"), F.lit(2.0).alias("l_extendedprice"), F.lit("x").alias("l_shipdate"), (F.col("id") % 7).cast("double").alias("l_quantity"))
    lines.repartition(40).write.parquet(f"{root}/lineitem.parquet")
    want: dict = {}
    for k in range(12000):
        problem, right = k - k % 2, k % 23 % 11 != 0 and k % 7 % 5 == (k - k % 2) % 5
        n, c, a = want.get(problem // 400, (0, 0, 0))
        want[problem // 400] = (n + 1, c + right, a + (not right and problem % 7 == 0))
    kept = manifest.commit
    monkeypatch.setattr(manifest, "commit", lambda rows, out, chunk: commits.append(chunk) or kept(rows, out, chunk))
    got = {r.part: (r.attempts, r.correct, r.alerts) for r in catalog.QUERIES["stream_progress"](spark, root).collect()}
    assert got == want and len(want) == 30 and len(commits) <= 16


def test_what_was_observed_must_be_what_was_committed(spark):
    found = spark.createDataFrame([(1, 2), (2, 3)], "part long, n long")
    assert progress.agreeing(found, spark.createDataFrame([(5,)], "n long"), ["n"]).count() == 2
    assert progress.agreeing(found.where("false"), spark.createDataFrame([], "n long"), ["n"]).count() == 0
    with pytest.raises(Exception, match="observed differs"):
        progress.agreeing(found, spark.createDataFrame([(4,)], "n long"), ["n"]).collect()


def test_chunks_grow_with_the_input(spark, tmp_path, monkeypatch):
    from chatquarry.plans import catalog

    root, seen, commits = str(tmp_path), [], []
    spark.range(170_000).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{root}/orders.parquet")
    spark.range(170_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_partkey"), F.lit(1).alias("l_suppkey"), F.lit(2.0).alias("l_extendedprice"), F.lit("x").alias("l_shipdate"), (F.col("id") % 5).cast("double").alias("l_quantity")).write.parquet(f"{root}/lineitem.parquet")
    chunks, commit = incremental.chunks, manifest.commit
    monkeypatch.setattr(incremental, "chunks", lambda s, path, *a: seen.append(len(s.read.parquet(path).inputFiles())) or chunks(s, path, *a))
    monkeypatch.setattr(manifest, "commit", lambda rows, out, chunk: commits.append(chunk) or commit(rows, out, chunk))
    got = catalog.QUERIES["stream_chunked_scoring"](spark, root)
    assert got.agg(F.count(F.lit(1)), F.sum("c"), F.max("n_runs")).first()[:] == (170_000, 170_000, 2)
    assert seen[0] > 3 and seen[1] > 6 and commits == list(range(len(commits))) and 2 < len(commits) <= 8


def test_means_of_many_runs_at_once():
    import numpy as np

    rng = np.random.default_rng(3)
    first = np.repeat([0, 7, 8, 40], [7, 1, 32, 60])
    values = rng.random(100)
    for rows, stretch in ((50, 1000), (5, 9), (1, 100)):
        want = [values[max(f, k - rows + 1) : k + 1].mean() for k, f in enumerate(first)]
        assert np.allclose(incremental._means(values, first, rows, stretch), want)
