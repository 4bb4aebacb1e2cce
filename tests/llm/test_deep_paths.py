"""Path templates below the third segment."""

from chatquarry.llm import url_filter


def test_templates_of_deep_paths(spark):
    rows = [(k, f"http://h.org/a/b/c/spam/{k}", True) for k in range(10)] + [(100 + k, f"http://h.org/a/b/c/news/{k}", False) for k in range(10)]
    rows += [(200, "http://h.org/a/b/c/spam/999", None), (201, "http://h.org/a/b/c/news/999", None), (202, "http://h.org/a/b/c", None)]
    long = "http://g.org/" + "s/" * 3000
    rows += [(300 + k, long + f"bad/{k}", True) for k in range(10)] + [(400 + k, long + f"good/{k}", False) for k in range(10)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), (), bad_col="bad").collect()}
    assert [got[k].verdict for k in (0, 100, 200, 201, 202, 300, 400)] == ["block", "allow", "block", "allow", "allow", "block", "allow"]
    assert (got[200].template, got[201].template, got[202].template) == ("/a/b/c/spam/{n}", "/a/b/c/news/{n}", "/a/b/c")


def test_unlabelled_branches_join_labelled_ones_of_their_structure(spark):
    users = ["ann", "bob", "cleo", "dora", "eve", "finn", "gus", "hal"]
    rows = [(k, f"http://h.org/{u}/post/{k}", True) for k, u in enumerate(users[:6]) for _ in range(2)]
    rows += [(10, "http://h.org/gus/post/77", None), (11, "http://h.org/help/page", None), (12, "http://h.org/about", None), (13, "http://other.org/gus/post/77", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), (), bad_col="bad").collect()}
    assert [(got[k].verdict, got[k].template) for k in (0, 10, 11, 12, 13)] == [("block", "/*/post/{n}"), ("block", "/*/post/{n}"), ("allow", "/help/page"), ("allow", "/about"), ("allow", "/gus/post/{n}")]
