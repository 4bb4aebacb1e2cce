"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from chatquarry.llm import chat_format, decontaminate, jaccard_join, language_id, mixing, pivot_neardup, quality, toxicity, url_filter, warc
from chatquarry.llm._shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, id long, rep long, size long, shard int, component long, key string"
LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(60_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs far away from here"


def docs(spark, empty=False):
    extra = (1, 1, 1, 1, 1, "k")
    rows = [
        (1, WORDS, "en", "a", *extra), (2, WORDS, "en", "a", *extra), (2, WORDS, "en", "a", *extra), (3, None, None, None, *extra), (4, "", "en", "b", *extra), (5, " \n\t ", "en", "b", *extra),
        (6, LONG, "de", "b", *extra), (7, LONG + " end", "de", "a", *extra), (None, "other text with few words in it", "fr", None, *extra), (8, "!!! ???", "fr", "a", *extra), (9, "a", None, "b", *extra),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.where("false") if empty else df


def labels(spark, empty=False):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    return df.where("false") if empty else df


@pytest.mark.parametrize("empty", [False, True])
def test_jaccard(spark, empty):
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs(spark, empty)).collect()}
    if empty:
        assert not got
        return
    assert (got[1].class_id, got[2].class_id, got[1].n_copies, got[2].kept) == (1, 1, 3, False)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (3, 4, 5, 8, 9))
    assert got[6].n_links == got[7].n_links == 1 and got[7].component_id == 6
    assert got[None].component_id is None and not got[None].kept
    kept = jaccard_join.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9]


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(spark, empty):
    df = docs(spark, empty)
    plan = mixing.mix_plan(df, carry=df.columns)
    rows = plan.collect()
    assert len(rows) == df.count()
    assert all(r.taken == r.size * len(r.shards) and r.taken <= 3 * r.size for r in rows)
    mixed = mixing.mix(df)
    assert set(mixed.columns) == set(df.columns) and mixed.count() == sum(len(r.shards) for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_classifiers(spark, empty):
    df = docs(spark, empty)
    for some in (labels(spark), labels(spark, True)):
        grader = quality.learn(quality.labelled(df, some, 100))
        graded = quality.grade(df, grader).collect()
        assert len(graded) == df.count() and all(0 <= r.tail <= 1 for r in graded)
        assert quality.select(df, grader).columns == df.columns
        quality.select(df, grader).collect()
        lexicon = toxicity.learn(toxicity.labelled(df, some, 100))
        scored = toxicity.score(df, lexicon).collect()
        assert len(scored) == df.count() and all(0 <= r.score <= 1 for r in scored)
        assert toxicity.reject(df, lexicon).columns == df.columns
        toxicity.reject(df, lexicon).collect()
    found = {r.doc_id: r for r in language_id.identify(df, language_id.learn(df)).collect()}
    assert len(found) == (0 if empty else 10)
    if not empty:
        assert all(found[k].lang_pred == "und" for k in (3, 4, 5, 8)) and found[1].lang_pred == "en" and found[6].lang_pred == "de"
    assert all(r.lang_pred == "und" for r in language_id.identify(df, {}).collect())


@pytest.mark.parametrize("empty", [False, True])
def test_decontamination(spark, empty):
    items = spark.createDataFrame([(1, WORDS), (1, WORDS), (2, None), (3, ""), (None, "four words are few"), (4, "jumps over the lazy dog")], "item_id long, text string")
    df = docs(spark, empty)
    for bench in (items, items.where("false")):
        got = {r.doc_id: r for r in decontaminate.flag(df, bench).collect()}
        assert len(got) == (0 if empty else 10)
        if not empty:
            hit = {k for k, r in got.items() if r.contaminated}
            assert hit == ({1, 2} if bench is items else set())
    assert decontaminate.clean(df, items).columns == df.columns
    assert decontaminate.clean(df, items).count() == (0 if empty else 8)


@pytest.mark.parametrize("empty", [False, True])
def test_vectors(spark, empty):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.001], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (2, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "vec": F.lit("x"), "copies": F.lit(0)})
    got = pivot_neardup.near_duplicates(df.where("false") if empty else df).collect()
    assert len(got) == (0 if empty else len(rows))
    if not empty:
        by = {r.vec_id: r for r in got}
        assert (by[1].n_links, by[2].n_links, by[3].n_links) == (3, 3, 3) and by[3].component_id == 1 and by[1].kept
        assert all(by[k].n_links == 0 and by[k].component_id == k for k in (4, 5, 6, 7, 8, 9, 10, 11, 12))


@pytest.mark.parametrize("empty", [False, True])
def test_archive(spark, empty):
    big = "x" * 100
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (1, "http://b\r\nX: y", big), (None, "n", big), (None, "n", "y" * 200), (8, "u%0D%0A", "é\r\n\r\nWARC/1.1\r\n" * 50), (9, "u", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(5), "digest": F.lit("d"), "payload": F.lit("p"), "first": F.lit(1)})
    df = df.where("false") if empty else df
    archive = warc.Archive(Scratch(spark, "test").path())
    warc.write(df, archive)
    got = warc.read(spark, archive)
    rows_back = got.collect()
    assert len(rows_back) == df.count()
    assert spark.read.parquet(archive.payloads).count() == spark.read.parquet(archive.payloads).select("digest").distinct().count()
    if empty:
        return
    kinds = {(r.id, r.record_type, r.refers_to) for r in rows_back}
    assert {(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (None, "revisit", 1), (None, "response", None)} <= kinds
    texts = {(r.id, bytes(r.payload).decode()) for r in rows_back}
    assert texts == {(i, h or "") for i, _, h in rows}
    assert {(r.id, r.url) for r in rows_back} == {(i, u) for i, u, _ in rows}
    heads = [bytes(r.header) for r in rows_back]
    assert len({h.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for h in heads}) == len(rows)
    records = {r.id: bytes(r.record) for r in warc.record_bytes(got).collect()}
    head, _, body = records[8].partition(b"\r\n\r\n")
    assert b"\r\nX: y" not in records[1].partition(b"\r\n\r\n")[0]
    assert int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")][0].split()[1]) == len(body) - 4
    assert records[2].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_damaged_archive(spark):
    archive = warc.Archive(Scratch(spark, "test").path())
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), archive)
    bad = warc.Archive(Scratch(spark, "test").path())
    spark.read.parquet(archive.headers).write.parquet(bad.headers)
    spark.read.parquet(archive.payloads).withColumn("payload", F.lit(b"y")).write.parquet(bad.payloads)
    with pytest.raises(Exception, match="damaged record"):
        warc.read(spark, bad).collect()


@pytest.mark.parametrize("empty", [False, True])
def test_chats(spark, empty):
    rows = [(1, 1, "assistant", "a"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "<|end|>\n"), (2, 0, "assistant", LONG), (None, 0, "user", "x"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "t": F.lit(2), "x": F.lit(3), "piece": F.lit(4)})
    df = df.where("false") if empty else df
    out = chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    if empty:
        assert not got
        return
    assert got == {1: [("user", ""), ("user", ""), ("assistant", "a")], 2: [("", "<|end|>\n"), ("assistant", LONG)], None: [("user", "x")], 3: [("assistant", "")]}
    masked = {r.conv_id: r.m for r in out.withColumn("m", chat_format.masked_text(F.col("formatted"), F.col("loss"))).collect()}
    assert masked == {1: "a", 2: LONG, None: "", 3: ""}


@pytest.mark.parametrize("empty", [False, True])
def test_urls(spark, empty):
    urls = [None, "", "no scheme", "http://", "HTTPS://Sub.Example.COM/en/1?x#y", "http://www.example.com/en/", "http://a.net/es/", "http://net/fr/x", "http://com", "x://É.com/é", "http://a.b/" + "s/" * 5000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(4, urls[4])], "page_id long, url string").withColumns({"host": F.lit("h"), "path": F.lit("p"), "bad": F.lit(True), "n": F.lit(1)})
    got = url_filter.judge(df.where("false") if empty else df).collect()
    if empty:
        assert not got
        return
    by = {r.page_id: (r.host, r.path[:20], r.rule, r.verdict) for r in got}
    assert len(got) == len(urls) + 1
    assert by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("", "", None, "allow")
    assert by[4] == ("sub.example.com", "/en/1", "example.com/en/", "block")
    assert by[5][2:] == ("www.example.com/en/", "allow") and by[6][2:] == ("net/es/", "block") and by[7][2:] == ("net/fr/", "block")
    assert by[8] == ("com", "", None, "allow") and by[9][2:] == ("com/", "allow")
