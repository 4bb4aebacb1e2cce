"""Queries over all rows that SQL can't express, against plain Python over small tables."""

import random

from chatquarry.plans import catalog


def test_failure_mode_responses(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([40, 290, 700]))) for _ in range(32)]
    texts = [t[:110] * 4 if k % 3 == 0 else t for k, t in enumerate(texts)]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r["mode"] for r in catalog.QUERIES["failure_mode_responses"](spark, str(tmp_path)).collect()}
    again = {k for k, t in enumerate(texts) if len(t) >= 300 and any(sum(t.startswith(t[i : i + 100], j) for j in range(len(t))) >= 3 for i in range(len(t) - 99))}
    assert set(got) == set(range(32)) and again and {k for k, m in got.items() if m == "repetition"} == again
    assert any(len(t) >= 300 and got[k] == "correct" for k, t in enumerate(texts))


def test_chats_of_all_rows(spark, tmp_path):
    long = "word " * 600 + "end"
    rows = [(1, 1, "assistant", "I see a point"), (4, 1, "assistant", "plain words"), (7, 1, "assistant", None), (0, 0, "user", long), (1, 0, "user", long), (3, 0, "user", long), (4, 0, "user", "short one")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda n: {r.conv_id: r[2] for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()}
    assert run("choice_label") == {1: None, 4: "C", 7: None}
    assert run("direct_answer_match") == {0: True, 1: True, 3: False, 4: True}
