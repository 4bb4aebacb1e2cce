"""Lexical search, token alignment and byte-level BPE against plain versions, with their edge cases."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chatquarry.llm import byte_bpe, lexical_search, token_alignment

P = pytest.importorskip("public_tokenizers")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS = list("abcdeRST  \n\t\r'sretvmdl0125.,!-_éßñ中文кир🎉👍🏽 \x1c\x85　²Ⅷǅ▁")
CONTROL = ["<|endoftext|>", "</s>", "<s>", "<unk>", "<0x41>", " " * 40, "a" * 300, "\n\n  x", "'re 'll 'vex"]


def some_text(rng, n):
    return "".join(rng.choice(CONTROL) if rng.random() < 0.05 else rng.choice(LETTERS) for _ in range(rng.randrange(n)))


def plain_search(docs, items, k=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, Counter(TERM.findall((t or "").translate(low)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, words, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out, asked = [], defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(TERM.findall((text or "").translate(low)))
    for item, terms in asked.items():
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // words
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in terms.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("shard", [(1 << 20, 1 << 20, 500), (7, 1 << 20, 3), (1 << 20, 60, 1)])
def test_search(spark, monkeypatch, shard):
    for name, value in zip(("SHARD_DOCS", "SHARD_POSTINGS", "QUERY_BLOCK"), shard):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(sum(shard))
    words = [f"w{k}" for k in range(40)] + ["Wörter", "日本", "the", "THE", "a_b", "x-1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    say = lambda n: " ".join(rng.choices(words, weights, k=rng.randrange(n)))
    docs = [(k, say(30)) for k in range(-40, 80)] + [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2"), (None, "w1 w2"), (7, None), (8, ""), (2**62, "w1 w7"), (-(2**62), "w1 w7"), (9, "w3 " * 5000), (10, " \n?")]
    items = [(k, say(12)) for k in range(25)] + [(3, "w1"), (3, "w1"), (None, "w2 the"), (90, None), (91, "nowhere"), (92, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit(1), "shard": F.lit(2), "rank": F.lit(3)}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = [tuple(r) for r in lexical_search.rank(df, asked).collect()]
    assert sorted(got, key=repr) == sorted(plain_search(docs, items), key=repr)
    for a, b in ((df.where("false"), asked), (df, asked.where("false")), (df.where("text is null"), asked)):
        assert lexical_search.rank(a, b).count() == 0


def test_a_whole_index_answers_the_same(spark, tmp_path):
    rng = random.Random(4)
    docs = [(k, " ".join(f"t{rng.randrange(50)}" for _ in range(rng.randrange(1, 20)))) for k in range(60)]
    items = [(k, f"t{k} t{k + 1} t{k}") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lexical_search.build_index(df).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.where("term is not null").agg(F.sum("words")).first()[0] == sum(len(t.split()) for _, t in docs)
    asked = lexical_search.query_terms(spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, lexical_search.search(index, asked, 4).collect())) == sorted(plain_search(docs, items, 4))


def test_packed_numbers():
    rng = random.Random(2)
    values = [0, 1, 127, 128, 16383, 16384, 2**63 - 1, 2**62] + [rng.randrange(1 << rng.randrange(1, 63)) for _ in range(500)]
    assert lexical_search.unpack(lexical_search.pack(lexical_search.np.array(values, "uint64"))).tolist() == values
    assert lexical_search.unpack(b"").tolist() == []


def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(P.path(byte_bpe.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefixes_of_small_vocabularies():
    rng = random.Random(1)
    for _ in range(60):
        ranks, made = {bytes([c]): c for c in range(256)}, [b"a", b"b", b"c"]
        while len(ranks) < 256 + rng.randrange(3, 30):
            x = rng.choice(made) + rng.choice(made)
            if x not in ranks and len(x) < 9:
                ranks[x] = len(ranks)
                made.append(x)
        p = byte_bpe.Prefixes(ranks)
        assert all(p.stay(ranks[a], ranks[b]) == (p.merged(a + b) == [ranks[a], ranks[b]]) for a in made for b in made)
        for _ in range(40):
            raw = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 30)))
            want = [ranks[raw]] if raw in ranks else p.merged(raw)
            assert byte_bpe.np.frombuffer(p.encode(raw), "<i4").tolist() == want == p.read(raw, p.grow(raw, []))


def test_encoding_and_decoding(spark):
    ranks, reference = reference_encoder()
    rng = random.Random(3)
    texts = [some_text(rng, 80) for _ in range(400)] + [None, "", " ", "the same", "the same", "x" * 5000, "ab" * 3000 + " " * 3000, "<|endoftext|>"]
    rows = [(k if k % 9 else None, t, 1, 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, last int")
    got = byte_bpe.decode(byte_bpe.encode(df, ranks, P.PATTERN), ranks).collect()
    want = [(k, reference.encode_ordinary(t or ""), (t or "").encode()) for k, t, *_ in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode(df.where("false"), ranks, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(df, {b"a": 0}, P.PATTERN)


def test_edits_equal_encoding_anew(spark):
    ranks, reference = reference_encoder()
    rng = random.Random(5)
    texts = {k: some_text(rng, 60) if k % 3 else "".join(rng.choice("abre") for _ in range(rng.randrange(400))) for k in range(300)}
    docs = spark.createDataFrame([*texts.items(), (1000, "left alone"), (None, "no id")], "doc_id long, text string")
    encoded = byte_bpe.encode(docs, ranks, P.PATTERN, prefixes=True)
    edits, want = [(5000, 0, 1, "of no row")], {1000: "left alone", None: "no id"}
    for k, t in texts.items():
        a = rng.randrange(len(t) + 1) if k % 4 else len(t)
        b, new = min(len(t), a + rng.randrange(5)), some_text(rng, 5)
        edits.append((k, a, b if b < len(t) else 10**6, new or None))
        want[k] = t[:a] + new + t[b:]
    changed = spark.createDataFrame(edits, "doc_id long, start int, stop int, text string")
    got = byte_bpe.reencode(encoded, changed, ranks, P.PATTERN).collect()
    again = byte_bpe.encode(spark.createDataFrame([*want.items()], "doc_id long, text string"), ranks, P.PATTERN, prefixes=True)
    fields = lambda r: (r.doc_id, r.ids, r.text, r.cuts, r.last)
    assert sorted(map(fields, got), key=repr) == sorted(map(fields, again.collect()), key=repr)
    assert all(r.ids == reference.encode_ordinary(r.text) for r in got)
    assert sum(r.redone for r in got) < 0.3 * sum(len(t.encode()) for t in want.values())
    same = byte_bpe.reencode(encoded, changed.where("false"), ranks, P.PATTERN)
    assert {r.doc_id: r.text for r in same.collect()} == {**texts, 1000: "left alone", None: "no id"}
    with pytest.raises(Exception, match="edits of one id"):
        byte_bpe.reencode(encoded, changed.union(changed), ranks, P.PATTERN).collect()


def plain_alignment(docs):
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    left = tokenizers.Tokenizer.from_file(P.path(token_alignment.LEFT))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=P.path(token_alignment.RIGHT))
    of = token_alignment.byte_of_char()
    raw_left = lambda i: bytes(of[c] for c in left.id_to_token(i))
    raw_right = lambda i: bytes([int(right.id_to_piece(i)[3:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    rows, count = [], Counter()
    for ident, text in docs:
        a, b = ([], []) if not text else (left.encode(" " + text, add_special_tokens=False).ids, right.encode(text))
        x, y = [raw_left(i) for i in a], [raw_right(i) for i in b]
        if b"".join(x) != b" " + (text or "").encode() or b"".join(y) != b"".join(x):
            a, b, x, y = [], [], [], []
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] for s in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [tuple([i for i, e in zip(ids, at) if lo < e <= hi] for ids, at in ((a, ends[0]), (b, ends[1]))) for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, e, s in zip(a, ends[0], x) for j, f, t in zip(b, ends[1], y) if e - len(s) < f and f - len(t) < e]
        count.update(set(links))
        rows.append((ident, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    digest = lambda gs: hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs).encode()).hexdigest() if gs else ""
    return [(i, a, b, len(g), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), digest(g)) for i, a, b, g, ls in rows]


@pytest.mark.parametrize("at_once", [1 << 20, 100])
def test_alignment(spark, at_once):
    rng = random.Random(8)
    docs = [(k if k % 11 else None, some_text(rng, 70)) for k in range(150)] + [(1, None), (2, ""), (3, " "), (4, "twice the same text"), (4, "twice the same text"), (5, "long " * 300), (6, "zzzzqx" * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"a": F.lit(1), "row": F.lit(2), "pair": F.lit(3)}).repartition(3)
    files = token_alignment._file(token_alignment.LEFT), token_alignment._file(token_alignment.RIGHT)
    got = token_alignment.alignment(df, *files, P.PATTERN, at_once=at_once)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_alignment(docs), key=repr)
    assert token_alignment.alignment(df.where("false"), *files, P.PATTERN).count() == 0


def test_links_and_groups_are_rows_of_ids(spark):
    files = token_alignment._file(token_alignment.LEFT), token_alignment._file(token_alignment.RIGHT)
    df = spark.createDataFrame([(1, "Unbelievable tokenizers align"), (2, None)], "doc_id long, text string")
    one, none = token_alignment.groups(token_alignment.align(token_alignment.tokenize(df, *files, P.PATTERN))).orderBy("doc_id").collect()
    assert sum((g.a for g in one.groups), []) == one.a and sum((g.b for g in one.groups), []) == one.b
    assert one.groups[-1].end == len(" Unbelievable tokenizers align") and len(one.links) == sum(len(g.a) + len(g.b) - 1 for g in one.groups)
    assert [x >> 32 for x in one.links][0] == one.a[0] and one.links[-1] & 0xFFFFFFFF == one.b[-1]
    assert none.groups == none.links == none.a == []


def test_alignment_works_on_lists_without_nulls(spark):
    """Numbers stay unboxed in Spark's sorts where a list is declared to hold no null; id 0 has no sign of its own in a group's text."""
    files = token_alignment._file(token_alignment.LEFT), token_alignment._file(token_alignment.RIGHT)
    left = token_alignment.Left(files[0], P.PATTERN)
    zero = left.bytes_of[0].decode()
    docs = [(k, t) for k, t in enumerate([zero, f"a{zero}", f"{zero}{zero} {zero}b", f"one{zero} two {zero}{zero}{zero}10 0", "none of it", f"{zero}\n{zero}é{zero}", "x" * 3000 + zero])]
    assert sum(0 in ids.tolist() for ids in left.encode([t for _, t in docs])) > 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = token_alignment.alignment(df, *files, P.PATTERN)
    assert sorted(map(tuple, got.collect())) == sorted(plain_alignment(docs))
    assert not any(f.dataType.containsNull for f in token_alignment.tokenize(df, *files, P.PATTERN).schema[1:])


def test_ranks_file(tmp_path):
    (tmp_path / "ranks").write_bytes(base64.b64encode(b"a") + b" 0\n\n" + base64.b64encode(b"\xff\x00") + b" 1\n")
    assert byte_bpe.read_ranks(str(tmp_path / "ranks")) == {b"a": 0, b"\xff\x00": 1}
