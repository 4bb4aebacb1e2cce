"""The whole decontamination against a plain version, on texts with signs, tags, inequalities and capitals."""

import os
import random

import pytest
import regex
from pyspark.sql import functions as F

from chatquarry.llm import decontaminate as d
from chatquarry.llm._shared import table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def plain_marked(text):
    text = regex.sub(f"[{d.NUM}-{d._END}]", " ", text or "")
    text = regex.sub(d._NUMBER, lambda m: f"{d.NUM}{m[0]}{d._NUM_END}", text)
    text = regex.sub(d._UNIT, lambda m: f"{d.UNIT}{m[1]}{d._END}", text)
    text = regex.sub(d._NAME, lambda m: f"{d.NAME}{m[0]}{d._END}", text)
    return [t.lower() for t in regex.findall(d._TOKEN, text)]


def plain_words(text):
    found = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+|[-+*/=<>^%×÷−]", text or "")]
    return found if regex.search(r"[\p{L}\p{N}]", text or "") else []


def slot(token):
    return token[:1] if token[:1] in (d.NUM, d.UNIT, d.NAME) else ""


def fits_at(ours, theirs, shift):
    """(consistent, equal) of the slots at a place."""
    maps = {k: set() for k in (d.NUM, d.UNIT, d.NAME, "inner")}
    for i, a in enumerate(ours):
        j = i + shift
        if slot(a) and 0 <= j < len(theirs) and slot(theirs[j]) == slot(a):
            b = theirs[j]
            maps[slot(a)].add((a, b))
            if slot(a) == d.NAME:
                n, parts = len(a.split(" ")), b[1:].split(" ")
                if len(parts) > n and i == 0:
                    b = d.NAME + " ".join(parts[-n:])
                elif len(parts) > n and i == len(ours) - 1:
                    b = d.NAME + " ".join(parts[:n])
                maps["inner"].add((a, b))
    ok = {k: len(m) == len({a for a, _ in m}) for k, m in maps.items()}
    return ok[d.NUM] and ok[d.UNIT] and (ok[d.NAME] or ok["inner"]), all(a == b for k in (d.NUM, d.UNIT, "inner") for a, b in maps[k])


def plain_match(text, item, window=d.WINDOW, words=d.WORDS):
    """None, or whether the item stands in the text as it is."""
    ours, theirs = plain_marked(item), plain_marked(text)
    width = min(window, len(ours))
    kind = lambda ts: tuple(slot(t) or t for t in ts)
    at = {}
    if len(ours) >= words:
        at = {k: kind(ours[k : k + width]) for k in range(len(ours) - width + 1) if sum(not slot(t) for t in ours[k : k + width]) >= words}
    verbatim = None
    hits = {(p - k, k) for p in range(len(theirs) - width + 1) for k, w in at.items() if kind(theirs[p : p + width]) == w}
    reached = lambda n: n >= d.COVERAGE * len(at) or n >= d.ENOUGH
    if hits and reached(len({k for _, k in hits})):
        by = {}
        for s, k in hits:
            by.setdefault(s, set()).add(k)
        most = max(map(len, by.values()))
        tried = [(s, len(ks) == len(at)) for s, ks in by.items() if reached(len(ks)) or len(ks) == most]
        if not any(map(slot, ours)):
            verbatim = most == len(at)
        elif any(fits_at(ours, theirs, s)[0] for s, _ in tried):
            verbatim = any(entire and fits_at(ours, theirs, s)[1] for s, entire in tried)
    mine, whole = plain_words(item), plain_words(text)
    if mine and len(mine) < d.LONG_ENOUGH:
        as_is = any(plain_words(x) == mine for x in regex.split(r"[\n\r]+|(?<=[.!?:;])\s+", text or ""))
    else:
        as_is = bool(mine) and any(whole[k : k + len(mine)] == mine for k in range(len(whole) - len(mine) + 1))
    return True if as_is else verbatim


WORDS = "we know that the train has gone where x y z of apples boxes left right more than twice as large small".split()
ODD = ["<", ">", "<p>", "</p>", "<br>", "<num>", "x<5", "y>12", "<who>", "-", "(", ")", ",", ".", ". ", "?\n", "3", "12", "3.5", "7 km", "5kg", "Anna", "Bob Jones", "Mary", "", "5", "É", "TWO", "If", "The"]


def phrase(rng, n):
    return " ".join(rng.choice(ODD) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n))


def changed(rng, text):
    kind = rng.randrange(7)
    if kind == 0:
        return text.upper()
    if kind == 1:
        return text.title()
    if kind == 2:
        return regex.sub(r"[0-9]+", lambda m: str(rng.randrange(99)), text)
    if kind == 3:
        return text.replace("Anna", "Eva").replace("12", "99")
    if kind == 4:
        parts = text.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        return " ".join(parts)
    return text


def test_random_texts(spark):
    rng = random.Random(11)
    items = [(k, phrase(rng, rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 20, 40]))) for k in range(40)]
    docs = []
    for k in range(220):
        parts = [phrase(rng, rng.randrange(12)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            item = changed(rng, rng.choice(items)[1])
            parts.insert(rng.randrange(len(parts)), rng.choice(["{}", "<p>{}</p>", "<br>{}", "x<5 {}", "x<{}", "{}<3"]).format(item))
        docs.append((k, rng.choice([" ", ". ", "\n"]).join(parts)))
    got = {(r.doc, r.item): r.verbatim for r in d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(k, i): found for k, t in docs for i, x in items if (found := plain_match(t, x)) is not None}
    assert got == want
    assert len(want) > 150 and {True, False} == set(want.values())


ITEM = "if the farmer has 3 apples and then buys 3 more apples, how many apples does he have in total"
BELOW = "If x<12 and y is twice as large as the number of boxes that were left over, what is the sum of both"
WHO = "the <who> of the house gave all of the old books to the <who> next door before the winter came"
TRAIN = "The train leaves the station at noon with 40 people and comes back with all of them before the evening"


@pytest.mark.parametrize("text, item, want", [
    ("we know that x<5 here. " + ITEM, ITEM, True), ("the tag <num> is used. " + ITEM, ITEM, True), ("a plain text. " + ITEM, ITEM, True),
    ("so " + BELOW.replace("x<12", "x<15"), BELOW, False), ("so " + BELOW, BELOW, True), ("<p>" + ITEM + "</p>", ITEM, True), ("<br>" + ITEM, ITEM, True),
    ("as " + WHO.replace("<who>", "who") + " again", WHO, True), (TRAIN.upper(), TRAIN, True), (TRAIN.title(), TRAIN, True), (TRAIN.replace("40", "70"), TRAIN, False), ("not " + TRAIN[:30], TRAIN, None),
])
def test_verbatim_items_among_signs_and_in_capitals(spark, text, item, want):
    row = d.flag(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert (row.contaminated, row.verbatim) == (want is not None, want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_tokens_are_one_pass(spark):
    rng = random.Random(2)
    some = spark.createDataFrame([(phrase(rng, 60),) for _ in range(200)], "text string").unionByName(table(spark, FOLDER, "documents").select("text"))
    rows = some.select("text", d.marked(F.col("text")).alias("t")).collect()
    assert all(r.t == plain_marked(r.text) for r in rows)
    assert all(len(t) > 1 for r in rows for t in r.t if slot(t))
