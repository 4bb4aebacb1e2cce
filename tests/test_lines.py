"""Line numbers, ordered prefixes and zipped files against sequential reads, with splits much smaller than files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chatquarry.plans import files
from chatquarry.sources import lines, readers


@pytest.fixture()
def small(spark):
    own = files.split_small(spark)
    own.conf.set("spark.sql.files.maxPartitionBytes", "200")
    own.conf.set("spark.sql.files.openCostInBytes", "10")
    return own


def some_files(folder, rng):
    """Files of lines: valid, without an answer, cut short, blank; one is empty, one has no line end."""
    folder.mkdir()
    out = []
    for k in range(5):
        rows = []
        for n in range(rng.randrange(60) if k else 0):
            good = json.dumps({"prompt": f"p{k}-{n} " + "é" * rng.randrange(40), "answer": rng.choice(["1", "2", ""])})
            rows.append(rng.choice([good, good, good, good[: len(good) // 2], "", "   "]))
        (folder / f"{k}.jsonl").write_text("\n".join(rows) + ("\n" if k != 3 and rows else ""), encoding="utf-8")
        out += [(f"{k}.jsonl", n, r) for n, r in enumerate(rows, 1) if not (k == 3 and n == len(rows) and r == "")]
    return out


def valid(text):
    try:
        row = json.loads(text)
    except ValueError:
        return None
    return row if row["answer"] else None


def test_numbers_and_prefixes(small, tmp_path):
    rng = random.Random(3)
    path = tmp_path / "in"
    rows = some_files(path, rng)
    name = lambda r: r.file.rsplit("/", 1)[1]
    assert lines.scan(small, str(path)).select("__file", "__start").distinct().count() > 12
    got = sorted((name(r), r.line, r.text) for r in lines.numbered(small, str(path)).collect())
    assert got == sorted(rows)
    broken = [(f, n, t) for f, n, t in rows if t.strip() and not t.endswith("}")]
    assert sorted((name(r), r.line, r.text) for r in readers.bad_lines(small, str(path), "validation").collect()) == sorted(broken) and len(broken) > 10
    good = [v["prompt"] for _, _, t in rows if t.strip() and (v := valid(t))]
    for most in (0, 1, 7, 40, len(good), len(good) + 5):
        kept = readers.lenient_json(small, str(path), "validation", F.col("answer") != "", most).collect()
        assert sorted(r.prompt for r in kept) == sorted(good[:most])
    first = min((f, n) for f, n, _ in broken)
    with pytest.raises(Exception, match="malformed line .*jsonl:[0-9]+: "):
        readers.strict_json(small, str(path), "validation").collect()
    (path / "4.jsonl").write_text(json.dumps({"prompt": "a", "answer": "b"}) + "\n")
    for k in range(4):
        (path / f"{k}.jsonl").write_text("")
    (path / "5.jsonl").write_text("\n\n" + json.dumps({"prompt": "a", "answer": ""}) + "\n")
    with pytest.raises(Exception, match="no answer in .*5.jsonl:3: "):
        readers.strict_prompts(small, str(path)).collect()
    assert [tuple(r) for r in readers.strict_prompts(small, str(path), 1).collect()] == [("a", "b")] and first
    with pytest.raises(Exception, match="no answer in .*5.jsonl, row 1"):
        readers.strict_prompts(small, str(path), 2).collect()


def test_zipped_files(small, tmp_path):
    rng = random.Random(6)
    for side, sizes in (("a", (30, 0, 55, 15)), ("b", (1, 60, 39))):
        (tmp_path / side).mkdir()
        n = 0
        for k, size in enumerate(sizes):
            (tmp_path / side / f"{k}.txt").write_text("".join(f"{side}{n + i} {'x' * rng.randrange(30)}\n" for i in range(size)))
            n += size
    left, right = lines.scan(small, str(tmp_path / "a")), lines.scan(small, str(tmp_path / "b"))
    number = lambda c: F.regexp_extract(c, "[ab]([0-9]+)", 1).cast("long")
    both = lines.zipped(left.withColumn("x", number("text")), right.withColumn("y", number("text")))
    assert sorted((r.position, r.x, r.y) for r in both.collect()) == [(k, k, k) for k in range(100)]
    (tmp_path / "b" / "2.txt").write_text("".join(f"b{61 + i}\n" for i in range(38)))
    with pytest.raises(Exception, match="only the first side has a row 99"):
        lines.zipped(left, lines.scan(small, str(tmp_path / "b")).drop("text").withColumn("y", F.lit(1))).collect()


def test_no_files_with_lines(small, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("")
    assert lines.numbered(small, str(tmp_path / "none")).count() == 0
    assert readers.lenient_json(small, str(tmp_path / "none"), "validation", None, 3).count() == 0
