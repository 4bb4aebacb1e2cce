"""Decontamination of items that repeat, have no id, hold few words, or stand in a document more than once."""

import random

from pyspark.sql import functions as F

from chatquarry.llm import decontaminate

QUESTION = "a farmer keeps many brown goats behind the old barn and wants to know how long the fence must be"
OTHER = "seven painters take turns to colour one very long wall while their friends mix fresh paint in small buckets all day"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.flag(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r.doc_id: (r.contaminated, r.n_items, r.item_ids, r.verbatim) for r in rows}


def test_items_that_repeat_or_have_no_id(spark):
    edited = QUESTION.replace("many", "some")
    texts = ["he said " + QUESTION + " and left", edited, "they say " + OTHER, "nothing of the kind is to be found in here at all"]
    hit, like, none = (True, 1, [1], True), (True, 1, [1], False), (False, 0, [], None)
    assert found(spark, texts, [(1, QUESTION)] * 3) == {0: hit, 1: like, 2: none, 3: none}
    assert found(spark, texts, [(1, QUESTION), (1, OTHER), (1, OTHER)]) == {0: hit, 1: like, 2: hit, 3: none}
    nameless = (True, 1, [], True)
    assert found(spark, texts, [(None, QUESTION), (None, OTHER), (None, None)]) == {0: nameless, 1: (True, 1, [], False), 2: nameless, 3: none}
    assert found(spark, texts, [(2, QUESTION), (1, QUESTION), (None, QUESTION)])[0] == (True, 3, [1, 2], True)


def test_items_of_few_words(spark):
    sums = "Compute 12 + 34 * 56 - 78"
    dense = "Add 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11 and 12"
    items = [(1, "What is 3 times 4 plus 5?"), (2, sums), (3, dense), (4, "two words"), (5, "!!!"), (6, QUESTION)]
    texts = [
        "He was asked, What is 3 times 4 plus 5? He didn't know", "what is 3 times 4 plus 6", sums.lower() + " now", sums.replace("*", "+"),
        "first " + dense + " then", dense.replace("11", "13"), "only two  Words, here", "two other words !!!", "", QUESTION + ", or " + sums, "So he said. Two words! No more", "here\ntwo words\nthere",
    ]
    got = found(spark, texts, items)
    assert {k: v[2] for k, v in got.items()} == {0: [1], 1: [], 2: [2], 3: [], 4: [3], 5: [], 6: [], 7: [], 8: [], 9: [2, 6], 10: [4], 11: [4]}
    assert all(v[3] is True for v in got.values() if v[0])
    assert {k: v[2] for k, v in found(spark, texts, items[:5]).items() if v[0]} == {0: [1], 2: [2], 4: [3], 9: [2], 10: [4], 11: [4]}
    assert not any(v[0] for v in found(spark, texts, items[4:5]).values())


def test_every_place_of_an_item_is_tried(spark):
    item = "If Anna buys 12 apples for 3 dollars each and sells 12 apples again, how much does the owner Anna have left after paying 3 dollars"
    mixed_up = item.replace("12", "25", 1).replace("3 ", "7 ", 1)
    other = item.replace("12", "25").replace("3 ", "7 ").replace("Anna", "Robert")
    texts = [mixed_up + ". " + item, mixed_up + ". " + mixed_up + ". " + other, mixed_up + ". " + mixed_up, item + ". " + mixed_up]
    got = found(spark, texts, [(7, item)])
    assert {k: (v[0], v[3]) for k, v in got.items()} == {0: (True, True), 1: (True, False), 2: (False, None), 3: (True, True)}


def test_documents_without_an_id(spark):
    other = "he said " + QUESTION + " and left"
    docs = spark.createDataFrame([(None, other), (None, other), (None, "nothing here at all"), (None, None), (1, None), (2, "the whole " + QUESTION)], "doc_id long, text string").withColumns({"key": F.lit(1), "Doc": F.lit(2), "held": F.lit(3)})
    items = spark.createDataFrame([("q", QUESTION)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.contaminated, tuple(r.item_ids)) for r in decontaminate.flag(docs, items).collect())
    assert got == [(0, False, ()), (0, False, ()), (0, True, ("q",)), (0, True, ("q",)), (1, False, ()), (2, True, ("q",))]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "nothing here at all"), (1, "")]
    rows = {(r.doc, r.text_md5 is None, r.item) for r in decontaminate.matches(docs, items).collect()}
    assert rows == {(None, False, "q"), (2, True, "q")}
    assert decontaminate.matches(docs, items.where("false")).count() == decontaminate.matches(docs.where("false"), items).count() == 0


PLACES = ["market", "harbour", "school", "garden", "station", "library", "factory", "museum"]
THINGS = ["apples", "boxes", "tickets", "candles", "bottles", "pencils", "carpets", "lamps"]
NAMES = ["Anna", "Robert", "Mary Ann Smith", "Yusuf", "Olga", "Chen", "Bob Jones", "Priya", "Émile", "Lars"]
UNITS = ["km", "kg", "hours", "days", "miles", "litres", "meters", "dollars"]
FORMS = [
    "{a} walks {x} {u} to the {p} every morning. {b} carries {y} heavy {t} along the same road. {a} meets {b} after {x} {u}. How many {t} do they carry in {z} weeks?",
    "The old {p} sells {x} {t} for {y} dollars each. {a} pays with a note of {z} dollars and gives half of the {t} to {b}. What does {a} have left?",
    "{a} and {b} share {x} {t} that weigh {y} {u} in all. If {b} takes {z} of them away from the {p}, how much does the rest of the {t} weigh?",
    "A train leaves the {p} with {x} {t} on board and arrives {y} {u} later; {a} unloads {z} {t} while {b} counts them twice over. How many remain?",
]


def test_recall_of_generated_questions(spark):
    """Items of the benchmark with other numbers, names and units, in running text; and clean texts of the same words."""
    rng = random.Random(12)
    items, texts = [], []
    for k in range(60):
        p, t = rng.choice(PLACES), rng.choice(THINGS)
        a, b, c, d = rng.sample(NAMES, 4)
        x, y, z = rng.sample(range(2, 99), 3)
        form = rng.choice(FORMS) + f" Give reasons of the kind {PLACES[k % 8][::-1]} {THINGS[k // 8][::-1]}."
        items.append((k, form.format(a=a, b=b, p=p, t=t, x=x, y=y, z=z, u=UNITS[0])))
        x, y, z = rng.sample(range(100, 999), 3)
        other = form.format(a=c, b=d, p=p, t=t, x=x, y=y, z=f"{z}.5", u=rng.choice(UNITS[1:]))
        words = [w for f in FORMS for w in f.split() if "{" not in w] + THINGS + PLACES + NAMES
        noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
        texts.append(noise(60) + ". " + other + " " + noise(60))
        texts.append(noise(150))
    got = found(spark, texts, items)
    hits = sum(got[2 * k][0] and k in got[2 * k][2] for k in range(60))
    assert hits >= 54 and not any(got[2 * k + 1][0] for k in range(60))
    assert not any(got[2 * k][3] for k in range(60) if got[2 * k][0])


def test_names_that_run_on_at_the_edges(spark):
    """A name before or after the item joins the item's own in one slot; it is still held, with other names too."""
    first = "Anna bought red apples at the old market and Anna sold green pears to her neighbours"
    last = "Who paid seven old ladies for the carts that Piet gave to the nephews of Piet"
    items = spark.createDataFrame([(1, first), (2, last)], "item_id long, text string")
    rows = [
        (1, f"so said Bob {first} today"),
        (2, f"they asked {last} Jansen that day"),
        (3, f"so said Bob {first.replace('Anna', 'Eva')} today"),
        (4, f"so it was {first.replace('Anna', 'Mary Ann')} today"),
        (5, f"so said Bob {first.replace('Anna', 'Carl', 1).replace('Anna', 'Dave')} today"),
        (6, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.contaminated, r.verbatim) for r in decontaminate.flag(docs, items).collect()}
    assert found == {1: (True, True), 2: (True, True), 3: (True, False), 4: (True, False), 5: (False, None), 6: (False, None)}
