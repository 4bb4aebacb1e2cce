"""Rows that repeat an id with another content: each content is compared, and every row has a result."""

from chatquarry.llm import jaccard_join, pivot_neardup


def test_vectors_that_repeat_an_id(spark):
    a, b, near_b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]
    rows = [(5, a, 1), (5, b, 1), (9, b, 1), (11, near_b, 1), (12, [0.0, 0.0, 1.0], 1)]
    got = pivot_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(5, 0, 5, True), (5, 2, 5, True), (9, 2, 5, False), (11, 2, 5, False), (12, 0, 12, True)]


def test_texts_that_repeat_an_id(spark):
    words = lambda c: [f"{c}{k}" for k in range(40)]
    a, b = " ".join(words("a")), " ".join(words("b"))
    near_a, near_b = a + " more", b + " more"
    rows = [(5, a), (5, b), (9, b), (11, near_b), (12, near_a), (13, "quite another text of its own")]
    for order in (rows, rows[::-1]):
        got = jaccard_join.jaccard_join(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.class_id, r.n_copies, r.n_links, r.component_id) for r in got) == [(5, 5, 1, 1, 5), (5, 5, 2, 1, 5), (9, 5, 2, 1, 5), (11, 11, 1, 1, 5), (12, 12, 1, 1, 5), (13, 13, 1, 0, 13)]


def test_texts_without_ids_and_with_clashing_names(spark):
    words = " ".join(f"a{k}" for k in range(40))
    other = " ".join(f"b{k}" for k in range(40))
    rows = [(1, words), (None, words + " more"), (None, words + " more"), (None, other), (None, other + " more"), (None, None), (None, None), (7, ""), (7, ""), (8, other[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_copies, r.n_links, r.component_id or 0, r.kept) for r in jaccard_join.jaccard_join(df).collect())
    assert got == [
        (0, 0, 1, 0, 0, False), (0, 0, 1, 0, 0, False), (0, 0, 1, 1, 0, False), (0, 0, 1, 1, 0, False), (0, 0, 2, 1, 1, False), (0, 0, 2, 1, 1, False),
        (1, 1, 1, 1, 1, True), (7, 7, 1, 0, 7, True), (7, 7, 1, 0, 7, True), (8, 8, 1, 0, 8, True),
    ]
    kept = jaccard_join.one_of_each(df.withColumns({"id": df.text, "exact": df.doc_id, "best": df.text, "Doc": df.text}))
    assert kept.columns == ["doc_id", "text", "id", "exact", "best", "Doc"]
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(texts) == 6 and {(1, words), (None, None), (7, ""), (8, other[:50])} <= set(texts) and sum(t == (None, None) for t in texts) == 2
    assert len([t for i, t in texts if t in (other, other + " more")]) == 1


def test_different_texts_of_an_id_all_stay(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, b + " more")]
    for order in (rows, rows[::-1]):
        assert sorted(tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(order, "doc_id long, text string")).collect()) == [(1, a), (1, b)]


def test_ids_and_labels_of_other_types(spark):
    words = " ".join(f"a{k}" for k in range(40))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame([("x", words), ("b", words + " more"), ("c", "z")], "doc_id string, text string")).collect()}
    assert got == {"x": "b", "b": "b", "c": "c"}
    rows = [("x", [1.0, 0.0], "l"), ("b", [1.0, 0.01], "l"), ("c", [1.0, 0.0], "m"), ("d", [1.0, 0.0], None)]
    got = {r.vec_id: (r.component_id, r.n_links) for r in pivot_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")).collect()}
    assert got == {"x": ("b", 1), "b": ("b", 1), "c": ("c", 0), "d": ("d", 0)}
