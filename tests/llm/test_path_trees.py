"""The whole path tree against a plain recursion over all levels, and nested paths that differ at every level."""

import random
import time
from math import sqrt

import pytest

from chatquarry.llm import url_filter as u


def plain_tree(paths, join_unlabelled=True):
    """{segments: template} from {segments: [n, labelled, bad]}, level by level as the docstrings say."""
    out = {}

    def below(node, rows):  # rows: (rest, n, lab, bad, original)
        kids = {}
        for rest, *x in rows:
            kids.setdefault(rest[0] if rest else "", []).append((rest, *x))
        total = [sum(r[k] for r in rows) for k in (1, 2, 3)]
        rate = (total[2] + 1) / (total[1] + 2)
        forms, star, about = set(), set(), {}
        for s, some in kids.items():
            n, lab, bad = (sum(r[k] for r in some) for k in (1, 2, 3))
            form = frozenset(r[0][1:] for r in some)
            alike = 0 < lab < total[1] and abs(bad / lab - rate) <= u.SIMILAR * sqrt(rate * (1 - rate) / lab)
            about[s] = (lab, form)
            if alike and s:
                forms.add(form)
            if s and (alike or len(kids) > u.SIBLINGS and n < u.SHARE * total[0]):
                star.add(s)
        if join_unlabelled:
            star |= {s for s, (lab, form) in about.items() if s and not lab and form in forms}
        merged = {}
        for s, some in kids.items():
            if not s:
                for r in some:
                    out[r[4]] = node
            else:
                merged.setdefault("*" if s in star else s, []).extend((r[0][1:], *r[1:]) for r in some)
        for s, some in merged.items():
            below((*node, s), some)

    below((), [(p, *c, p) for p, c in paths.items()])
    return out


@pytest.mark.parametrize("join_unlabelled", [True, False])
def test_random_trees(spark, join_unlabelled):
    rng = random.Random(4)
    rows = []
    for host in range(6):
        names = ["a", "b", "c", "d"] if host < 4 else [f"n{chr(97 + k)}x" for k in range(26)]
        for _ in range(250):
            path = [rng.choice(names) for _ in range(rng.choice([0, 1, 2, 3, 5, 8]) if host < 4 else rng.randrange(3))]
            bad = rng.choice([None, None, True, False]) if host % 2 else rng.choice([None, "a" in path[:1]])
            rows.append((len(rows), f"http://h{host}.org/" + "/".join(path), bad))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r.template for r in u.judge(df, (), bad_col="bad", join_unlabelled=join_unlabelled).collect()}
    stars = 0
    for host in range(6):
        paths, mine = {}, [(k, tuple(s for s in url.split("/")[3:] if s), bad) for k, url, bad in rows if f"h{host}." in url]
        for _, p, bad in mine:
            c = paths.setdefault(p, [0, 0, 0])
            c[0], c[1], c[2] = c[0] + 1, c[1] + (bad is not None), c[2] + bool(bad)
        tree = plain_tree(paths, join_unlabelled)
        assert {k: got[k] for k, *_ in mine} == {k: "/" + "/".join(tree[p]) for k, p, _ in mine}
        stars += sum("*" in t for t in tree.values())
    assert stars > 100


def test_200_nested_levels(spark):
    rows = [(k, "http://trap.org/" + "a/" * k, None) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    start = time.time()
    got = {r.page_id: r.template for r in u.judge(df, (), bad_col="bad").collect()}
    assert got[150] == "/" + "/".join("a" * 150) and len(set(got.values())) == 200
    assert time.time() - start < 60
