"""The sweep against trying every rule, and the registered query against its SQL."""

import random

from evidence.llm import url_filters as U


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules
        if h and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")
    ]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_every_rule_tried(spark):
    pick = random.Random(4)
    labels, parts = ["a", "b", "com", "net", "x-y", "é"], ["/", "/a", "/a/", "/a/b", "/ab", "/\U0010ffff", "/é", ""]
    host = lambda n: ".".join(pick.choice(labels) for _ in range(pick.randint(1, n)))
    rules = {(host(3), pick.choice(parts)): pick.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host(4)}{pick.choice(parts)}{pick.choice(parts)}{pick.choice(['', '?q=/a', '#x'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http:///a", "HTTP://A.COM/a", "ftp://a.b?x://y", "http://" + "a." * 300 + "com/a", "http://com"] + ["http://a.com/a/b"] * 50
    pages = spark.createDataFrame([(i, u, "own", "own", "own") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, _key string").repartition(5)
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("b", "/", None)], "host string, path string, verdict string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # more ranges than the rules fill
    try:
        found = U.judge_urls(pages, table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(found) == len(urls)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], rules), urls[r.page_id]


def test_nothing_to_judge(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert U.judge_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id bigint, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in U.judge_urls(one, rules).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert {r.verdict for r in U.judge_urls(one, rules.limit(0), default="block").collect()} == {"block"}


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = spark.sql("SELECT 'com' AS host, '/' AS path, 'block' AS verdict")
    plan = U.judge_urls(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
