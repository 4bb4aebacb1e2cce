"""Operators against plain Python over small inputs, and classifiers by their held-out accuracy."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatquarry.llm import chat_format, decontaminate, jaccard_join, mixing, pivot_neardup, registry, toxicity, url_filter
from chatquarry.llm._shared import Scratch, components

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
with_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def closure(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_jaccard_join(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    hot = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(300):  # more than a block of near copies
        copy = list(hot)
        copy[rng.randrange(120)] = f"h{k % 250}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(tuple(t.split()), i)
    reps = sorted(first.values())
    sets = {i: shingles(texts[i]) for i in reps}
    links = [(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    degree = Counter(x for pair in links for x in pair)
    root = closure(reps, links)
    copies = Counter(first[tuple(t.split())] for t in texts)
    for i, t in enumerate(texts):
        c = first[tuple(t.split())]
        assert (got[i].class_id, got[i].n_copies, got[i].n_links, got[i].component_id, got[i].kept) == (c, copies[c], degree[c], root[c], root[c] == i)


def test_bayesian_bound_keeps_what_reaches_the_threshold():
    for n in (16, 48, 80):
        least = jaccard_join.least_matches(0.8, 1e-5, n)
        rng = np.random.default_rng(n)
        assert (rng.binomial(n, 0.8, 100_000) < least).mean() < 1e-3 and least > 0.3 * n


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 500)] + 0.08 * rng.normal(size=(500, 16)), rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(1, 16)), 40, axis=0)])
    label = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(k, [float(c) for c in v], int(c)) for k, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    root = closure(range(len(x)), list(zip(*np.nonzero(close))))
    rows = {r.vec_id: r for r in pivot_neardup.near_duplicates(df).collect()}
    found = sum(r.n_links for r in rows.values())
    assert found <= close.sum() and found >= 0.97 * close.sum()
    assert np.mean([rows[k].component_id == root[k] for k in range(len(x))]) > 0.97
    assert all(rows[k].kept == (rows[k].component_id == k) for k in range(len(x)))


@pytest.mark.parametrize("links", [[(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)], [(k, 400 - k) for k in range(150)], [(5, 5)], []])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    root = closure({x for p in links for x in p}, links)
    got = {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in links)}


def test_targets():
    rng = random.Random(2)
    for _ in range(200):
        sizes = np.array([float(rng.choice([0, 1, 5, 50, 1000])) for _ in range(rng.randrange(1, 9))])
        weights = np.array([1.0 + k % 3 for k in range(len(sizes))])
        target = mixing.fill(sizes, weights, sizes.sum(), 3.0)
        assert target.sum() == pytest.approx(sizes.sum()) and (target <= 3 * sizes + 1e-9).all()
        free = (target < 3 * sizes - 1e-9) & (sizes > 0)
        if free.any():
            level = target[free] / weights[free]
            assert np.allclose(level, level[0]) and (target[~free & (sizes > 0)] <= level[0] * weights[~free & (sizes > 0)] + 1e-6).all()


def test_splitting_tree_deals_every_block_once():
    counts = np.array([0, 1, 7, 400, 33])
    for shards in (1, 2, 5, 16):
        seen = {}
        for shard in range(shards):
            first, n = mixing.leaf(counts, shards, shard, 9)
            for s in range(len(counts)):
                for p in range(first[s], first[s] + n[s]):
                    assert seen.setdefault((s, p), shard) == shard
        assert set(seen) == {(s, p) for s, c in enumerate(counts) for p in range(c)}
        load = Counter(seen.values())
        assert max(load.values()) - min(load.values()) <= max(1, len(bin(shards)) - 2)


def test_mix_of_tables(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("x" * rng.randrange(1, 300)).strip(), rng.choice(["a", "b", "é", None, "𝒳"])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r.doc_id, r.taken, tuple(r.shards), r.target, r.source_size) for r in mixing.mix_plan(d, block_words=2000, shard_words=5000).collect()) for d in (df, df.repartition(7)))
    assert one == two
    size, of = {k: len(t.split()) for k, t, _ in rows}, {k: s for k, _, s in rows}
    names = sorted({s for s in of.values() if s is not None}) + [None]
    total = Counter()
    for k, s in of.items():
        total[s] += size[k]
    want = mixing.fill(np.array([float(total[s]) for s in names]), np.array([1.0, 2.0, 3.0, 1.0, 2.0]), float(sum(total.values())), 3.0)
    taken = Counter()
    for k, t, _, target, source_size in one:
        taken[of[k]] += t
        assert target == pytest.approx(want[names.index(of[k])]) and source_size == total[of[k]] and t % max(1, size[k]) == 0
    for s, w in zip(names, want):
        assert abs(taken[s] - w) <= 300


def test_control_strings_round_trip(spark):
    rng = random.Random(8)
    parts = [*chat_format.CONTROL, "\\", "<", "|", ">", "[", "/", "INST]", "turn", "é", "\n", "<\\|", "\\\\"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escape(F.col("t"))).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    assert all(r.u == r.t and not any(c in r.e for c in chat_format.CONTROL) for r in rows)


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.5, None)]), (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 2), ("text", "<|ok", None, None, None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = chat_format.format_chats(df).first()
    assert got.formatted == "<|turn|>user<|says|>see<|image:0|><|audio:1|><|end|>\n<|turn|>assistant<|says|><|document:2|><\\|ok<|end|>\n"
    assert [(a.position, a.turn, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, 0, "image", "i.png", 4), (1, 0, "audio", "a.wav", 38), (2, 1, "document", "d.pdf", 512)]
    assert got.formatted[got.loss[0].start - 1 :][: got.loss[0].n] == "<|document:2|><\\|ok"


def test_templates_learn_from_labels(spark):
    rows = [(k, f"http://h.org/spam/{k}", True) for k in range(10)] + [(100 + k, f"http://h.org/news/{k}", False) for k in range(10)] + [(200, "http://h.org/spam/999", None), (201, "http://h.org/news/999", None), (202, "http://h.org/other/1", None), (203, "http://new.org/spam/1", None)]
    rows += [(300 + k, f"http://u.org/user{'abcdefghijklmnopqrstuvwxyz'[k % 26] * (1 + k // 26)}/post", k % 2 == 0 or None) for k in range(60)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), (), bad_col="bad").collect()}
    assert [got[k].verdict for k in (0, 100, 200, 201, 202, 203)] == ["block", "allow", "block", "allow", "allow", "allow"]
    assert got[300].template == "/*/post" and got[301].verdict == "block" and got[200].template == "/spam/{n}"


def test_large_draws():
    rng = np.random.default_rng(3)
    good, bad, draws = 3 * 10**9, 5 * 10**9, 2 * 10**9
    got = np.array([mixing._hypergeometric(rng, good, bad, draws) for _ in range(60)], np.float64)
    n, p = good + bad, good / (good + bad)
    spread = (draws * p * (1 - p) * (n - draws) / (n - 1)) ** 0.5
    assert abs(got.mean() - draws * p) < 5 * spread / 60**0.5 and 0.7 < got.std() / spread < 1.4
    assert mixing._hypergeometric(rng, 5, 10**10, 10**10 + 5) == 5 and mixing._hypergeometric(rng, 0, 10**10, 7) == 0
    small = [mixing._hypergeometric(rng, 2, 10**9, 5 * 10**8) for _ in range(300)]
    assert {0, 1, 2} == set(small) and abs(np.mean(small) - 1) < 0.25


def brute_mix(rows, sources, block_words, seed, ids):
    """What a plain loop takes of each source: whole passes, then blocks, then documents of the block at the edge."""
    out = Counter()
    for s, (target, size, n_blocks) in sources.items():
        passes, room = int(target / size + 1e-9), 0.0
        room = target - passes * size
        blocks = {}
        for i, n in rows[s].items():
            blocks.setdefault(ids[i][0] % n_blocks, []).append(i)
        for i in rows[s]:
            out[i] += passes
        for b in sorted(blocks, key=lambda b: (ids["block", s, b], b)):
            held = sum(rows[s][i] for i in blocks[b])
            if held <= room:
                room -= held
                out.update(blocks[b])
                continue
            left = []
            for i in sorted(blocks[b], key=lambda i: ids[i][1]):
                if rows[s][i] <= room:
                    room -= rows[s][i]
                    out[i] += 1
                else:
                    left.append(i)
            near = min(left, key=lambda i: abs(rows[s][i] - room), default=None)
            if near is not None and abs(rows[s][near] - room) < room:
                out[near] += 1
            break
    return out


def test_mix_equals_a_plain_loop(spark):
    rng = random.Random(14)
    docs = [(k, " ".join(["x"] * rng.randrange(1, 200)), rng.choice("abcd")) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = {r.doc_id: r for r in mixing.mix_plan(df, block_words=1500, shard_words=4000).collect()}
    names, size = sorted({s for _, _, s in docs}), {k: len(t.split()) for k, t, _ in docs}
    total = {s: float(sum(size[k] for k, _, x in docs if x == s)) for s in names}
    want = mixing.fill(np.array([total[s] for s in names]), np.array([1.0, 2.0, 3.0, 1.0]), sum(total.values()), 3.0)
    sources = {s: (w, total[s], max(1, int(np.ceil(total[s] / 1500)))) for s, w in zip(names, want)}
    ids = {r.doc_id: (r.a, r.b) for r in df.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("a"), F.xxhash64(F.lit(44), "doc_id").alias("b")).collect()}
    keys = spark.createDataFrame([(k, s, b) for k, s in enumerate(names) for b in range(sources[s][2])], "s int, name string, block int")
    ids |= {("block", r.name, r.block): r.h for r in keys.select("name", "block", F.xxhash64(F.lit(43), "s", "block").alias("h")).collect()}
    got = brute_mix({s: {k: size[k] for k, _, x in docs if x == s} for s in names}, sources, 1500, 42, ids)
    assert {k: len(r.shards) for k, r in plan.items()} == {k: got[k] for k in plan}
    mixed = mixing.mix(df.withColumn("Shard", F.lit(0)), block_words=1500, shard_words=4000)
    assert Counter(r.doc_id for r in mixed.collect()) == +got and mixed.columns == ["doc_id", "text", "source", "shard"]
    parts = [p for p in mixed.select("shard", "doc_id").rdd.glom().collect() if p]
    assert all([r.shard for r in p] == sorted(r.shard for r in p) for p in parts) and len({r.shard for p in parts for r in p}) == sum(len({r.shard for r in p}) for p in parts)
    assert any([r.doc_id for r in p] != sorted(r.doc_id for r in p) for p in parts)
    assert all(len(set(r.orders)) == len(r.shards) for r in plan.values())
    few = spark.createDataFrame([(k, "w" if k < 20 else "", "s", 1.0, 2) for k in range(400)], "doc_id long, text string, source string, size double, Taken int")
    out = mixing.mixed(few)
    assert out.columns == ["doc_id", "text", "source", "size_of_document", "Taken_of_document", *mixing.PLANNED] and out.agg(F.sum("taken")).first()[0] == 20


def test_reparameterised_questions(spark):
    item = "If Anna buys 12 apples for 3 dollars each and sells 12 apples again, how much does the owner Anna have left after paying 3 dollars"
    other = item.replace("12", "25").replace("3 ", "7 ").replace("Anna", "Robert")
    mixed_up = item.replace("12", "25", 1).replace("3 ", "7 ", 1)
    texts = ["so said he, " + item + " and so on", "lower " + other, mixed_up, item.lower(), "nothing of the kind is to be found in here at all, not at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.verbatim) for r in decontaminate.flag(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[0] == (True, True) and got[1] == (True, False) and got[2][0] is False and got[4] == (False, None)


@with_tables
def test_verbatim_passages_are_found_and_nothing_else(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))
    bench = [r.text for r in items.collect()]
    got = {r.doc_id: r.contaminated for r in registry.queries()["op10_decontaminate"](spark, FOLDER).collect()}
    want = {r.doc_id: any(b in r.text for b in bench) for r in docs.collect()}
    assert got == want


def test_folding_and_exceptions(spark):
    assert toxicity.fold("1d10t ІDІОТ Ｉｄｉｏｔ idi\u200bot 2024 $5") == "idiot idiot idiot idiot 2024 $5"
    assert toxicity.fold("i\u0308di\u0301ot \U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d b000b i.d.i.o.t i-d-i-o-t ıdıot") == "idiot idiot booob idiot idiot idiot"
    assert toxicity.fold("e.g. a.b well-known x.y.z1 10.5 Straße naïve") == "e.g. a.b well-known x.y.zi 10.5 straße naive"
    lexicon = toxicity.Lexicon({"^idiot$": 5.0, "^trash": 4.0}, (-2.0, 1.0, 1.0))
    rows = [(1, "you 1d10t"), (2, "the trash can is full"), (3, "trashy trash"), (4, "idiotic"), (5, "clean"), (6, "an idiot, " + "fine words " * 5000)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()}
    assert {k: r.n_hits for k, r in got.items()} == {1: 1, 2: 0, 3: 2, 4: 0, 5: 0, 6: 1}
    assert got[1].predicted == 1 and got[5].predicted == got[2].predicted == 0 and got[6].score < got[1].score


@with_tables
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    run = registry.queries()
    tox = run["op3_toxicity"](spark, FOLDER).join(labels, "doc_id").where("held_out").toPandas()
    assert (tox.predicted == tox.toxic).mean() > 0.95 and (tox[tox.toxic == 0].predicted == 0).all()
    grade = run["op8_quality"](spark, FOLDER).join(labels, "doc_id").where("held_out").toPandas()
    assert (grade.keep.astype(int) == grade.quality).mean() > 0.95
    lang = run["op9_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and n > 100").toPandas()
    assert (lang.lang_pred == lang.lang).mean() > 0.93


def test_quality_orders_more_than_two_grades(spark):
    from chatquarry.llm import quality

    rng = random.Random(3)
    kinds = {0: ["bad", "poor"], 1: ["fair", "plain"], 2: ["good", "fine"]}
    rows = [(k, " ".join(rng.choice(kinds[k % 3] + ["the", "of"]) for _ in range(30)), k % 3) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    grader = quality.learn(df.where("doc_id < 240").select("text", "grade"))
    assert list(grader.thresholds) == sorted(grader.thresholds) and len(grader.thresholds) == 2
    got = {r.doc_id: r for r in quality.grade(df.where("doc_id >= 240"), grader, at_least=2).collect()}
    assert all(round(got[k].expected_grade) == k % 3 and got[k].keep == (k % 3 == 2) for k in got)


@with_tables
def test_sql_of_registered_queries(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, FOLDER)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        show = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
        key = sorted(names)
        assert sorted(tuple(show(r[c]) for c in key) for r in df.collect()) == sorted(tuple(show(r[names.index(c)]) for c in key) for r in cur.fetchall()), name


def test_loss_digest(spark):
    text = "é𝒳 ok"
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    masked = out.select(chat_format.masked_text(F.col("formatted"), F.col("loss")).alias("m")).first().m
    assert hashlib.sha256(masked.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest() and len(masked) == len(text)


def test_lexicon_scan_equals_a_plain_search(spark):
    weights = {"^idiot$": 5.0, "^trash": 4.0, "^trashy": 4.5, "^id": 1.0, "^can$": 0.5}
    lexicon = toxicity.Lexicon(weights, (-2.0, 1.0, 1.0), ("trash can", "idiot box"))
    rng = random.Random(21)
    parts = ["idiot", "1d10t", "idiots", "trash", "trashy", "can", "cans", "box", "Trash", "idea", "İd", "x", ",", ".", "-", "t.r.a.s.h", "é", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(25))) for _ in range(400)] + ["", None]

    def plain(text):
        folded, hits, excused = toxicity.fold(text or ""), {}, []
        ends = lambda b: b == len(folded) or not folded[b].isalnum()
        for a in range(len(folded)):
            if a and folded[a - 1].isalnum():
                continue
            found = [w for t, w in weights.items() if folded.startswith(t[1:].rstrip("$"), a) and (not t.endswith("$") or ends(a + len(t) - 2))]
            if found:
                hits[a] = max(found)
            excused += [(a, a + len(p)) for p in ("trash can", "idiot box") if folded.startswith(p, a) and ends(a + len(p))]
        left = [w for a, w in hits.items() if not any(x <= a < y for x, y in excused)]
        words = (text.count(" ") + text.count("\n") + 1) if text else 0
        return len(left), 100 * sum(left) / (words + 20)

    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()}
    for k, text in enumerate(texts):
        n, density = plain(text)
        assert got[k].n_hits == n and got[k].density == pytest.approx(density) and got[k].predicted == (got[k].score >= 0.5), text


def test_grades_and_languages_equal_plain_loops(spark):
    import math

    import pyarrow as pa
    import zstandard

    from chatquarry.llm import language_id, quality

    rng = random.Random(5)
    some = {"en": "the cat sat on a mat and looked at the dog over there", "de": "der hund lief über die straße und sah das kleine haus dort", "fr": "le chat dort sur la chaise et regarde les oiseaux du jardin"}
    texts = [" ".join(rng.choice(some[lang].split()) for _ in range(rng.choice([1, 8, 900]))) for lang in list(some) * 25] + ["", None, "!!! 12", "  \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    grader = quality.Grader(np.random.default_rng(1).normal(size=quality.WIDTH), np.array([-0.2, 0.1]), [0, 1, 2])
    dictionaries = {lang: (words * 40).encode() for lang, words in some.items()}
    graded = {r.doc_id: r for r in quality.grade(df, grader).collect()}
    named = {r.doc_id: r for r in language_id.identify(df, dictionaries).collect()}
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for k, text in enumerate(texts):
        with np.errstate(over="ignore"):
            index, _ = quality.features(pa.array([text], pa.string()))
        f = sum(grader.weights[i] for row in index for i in row) / max(1, len((text or "").split()))
        below = [logistic(t - f) for t in grader.thresholds]
        assert graded[k].tail == pytest.approx(1 - below[0]) and graded[k].expected_grade == pytest.approx((below[1] - below[0]) + 2 * (1 - below[1]))
        if not any(map(str.isalpha, text or "")):
            assert (named[k].lang_pred, named[k].score) == ("und", 0.0)
            continue
        sizes = {}
        for lang, raw in dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, source_size=language_id.BLOCK, dict_size=len(raw), write_checksum=0, write_content_size=0, write_dict_id=0)
            coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            whole = text.lower().encode()
            sizes[lang] = sum(len(coder.compress(whole[a : a + language_id.BLOCK])) for a in range(0, len(whole), language_id.BLOCK))
        assert named[k].lang_pred == min(sorted(sizes), key=sizes.get)
