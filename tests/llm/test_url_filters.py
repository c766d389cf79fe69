"""URL rules against brute force: many nested rules, few and many lanes, odd hosts."""

import random
import re

import pytest

from sparsewide.llm import url_filters


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    own = ".".join
    names = {own(host.split(".")[k:]) for k in range(len(host.split(".")))}
    fit = [(len(h + p), h + p, a) for name in names for h, p, a in rules.get(name, ()) if path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("kw", [{}, {"range_hosts": 3, "broadcast_hosts": 0}])
def test_many_nested_rules_equal_brute_force(spark, kw):
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "c", "example", "x-y", "com", "net", "b0"])
    host = lambda: ".".join(label() for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))
    path = lambda: "/" + "/".join(rng.choice(["en", "de", "7", ""]) for _ in range(rng.randrange(3)))
    rules = [(host(), path(), rng.choice(["block", "allow"])) for _ in range(600)] + [("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("a", None, "block")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(1500)] + ["http://HOT.example.com/en/7"] * 400
    urls += [None, "", "://", "no scheme", "http://", "http://.com/en", "http://a..b/", "http://com./en", "http://x/" + "y" * 200_000, "http://" + "s." * 300 + "com/"]
    by = {}
    for h, p, a in rules:
        if h is not None and p is not None:
            by.setdefault(h, []).append((h, p, a))
    pages = spark.createDataFrame([(k, u, "clash", "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, key string, stack string, range string").repartition(4)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, spark.createDataFrame(rules, url_filters.RULE_SCHEMA), **kw).collect()}
    for k, u in enumerate(urls):
        assert got[k] == brute(u, by), u
    assert len({v[2] for v in got.values()}) > 50


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr("concat('h', id, '.example.com') AS host", "'/' AS path", "if(id % 2 = 0, 'block', 'allow') AS action")
    pages = spark.createDataFrame([(1, "http://h99998.example.com/x"), (2, "http://www.h7.example.com/"), (3, "http://h100000.example.com/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules).collect()} == {1: ("h99998.example.com/", "block"), 2: ("h7.example.com/", "allow"), 3: (None, "allow")}
