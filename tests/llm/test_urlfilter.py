import random

import pytest

from wordloom.llm import urlfilter
from wordloom.llm.queries import RULES

PAGES, RULE = "page_id long, url string", "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


def check(spark, urls, rules):
    rows = [(i, u) for i, u in enumerate(urls)]
    got = urlfilter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(rules, RULE)).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute(u, rules) for u in urls]


URLS = ["http://example.com/en/1", "https://www.Example.com/en/2?x#y", "https://a.www.example.com/en/", "http://x.net/es/", "http://net/fr/a", "http://notnet/fr/a",
        "http://com", "http://com/", "ftp://.com/", "http://example.com?en/", "example.com/en/", "", None, "://", "http:///en/", "http://u:p@example.com:80/en/",
        "http://ÀB.com/é", "http://example.com/en", "http://a..com/", "http://x.com/en/" + "a" * 5000, "http://b.net/es/#://c.com/"]


def test_contract_rules(spark):
    check(spark, URLS, RULES)


@pytest.mark.parametrize("seed", range(2))
def test_nested_rules_over_many_ranges(spark, monkeypatch, seed):
    monkeypatch.setattr(urlfilter, "ROWS_PER_RANGE", 20)
    rnd = random.Random(seed)
    host = lambda: ".".join(rnd.choice(["a", "b", "ab", "www"]) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "/a", "/b", "a", "\U0010ffff"]) for _ in range(rnd.randint(0, 5)))
    rules = list({(host(), path()): rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    check(spark, [f"http://{host()}/{path()}" for _ in range(300)], [(h, p, v) for (h, p), v in rules])


def test_one_url_many_times(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "ROWS_PER_RANGE", 20)
    check(spark, ["http://www.example.com/en/x"] * 200 + URLS, RULES)


def test_repeats_nulls_and_equal_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x")] * 3 + [(None, "http://a.b/x"), (None, None)], PAGES)
    rules = spark.createDataFrame([("b", "/", "allow"), ("b", "/", "block")], RULE)
    got = urlfilter.judge(pages, rules).collect()
    assert [r["verdict"] for r in got if r["page_id"] == 1] == ["block"] * 3
    assert sorted((r["host"], r["verdict"]) for r in got if r["page_id"] is None) == [("", "allow"), ("a.b", "block")]


def test_empty(spark):
    pages, rules = spark.createDataFrame([(1, "http://a/")], PAGES), spark.createDataFrame(RULES, RULE)
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert urlfilter.judge(pages, rules.limit(0)).first()["verdict"] == "allow"
    extra = pages.selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS rule", "1 AS n", "2 AS k")
    assert urlfilter.judge(extra, rules).first()["host"] == "a"
