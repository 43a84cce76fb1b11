import random

import pytest

from pitlake.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://", "https://a.example.com/en/71?x#y", "HTTP://A.EXAMPLE.COM/en/6", "http://example.net/de/8#f", "http://x.net/de/", "http://org/es/1",
    "http://evilcom/en/", "http://x.com?/en/", "http://x.com#a", "http://É.com/en/é", "ftp://u.com/en", "a://b.com/en/://c", "http://x.com/EN/",
]


def brute(url, rules):
    host, path = u.split_url(url)
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            size = (len(h) + len(p), len(h), verdict == "block")
            best = max(best or ((-1,), "", ""), (size, h + p, verdict))
    return (best[1], best[2]) if best else (None, "allow")


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string").repartition(3)
    out = u.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), **options).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r.rule, r.verdict) == brute(r.url, rules), r
        assert (r.host, r.path) == u.split_url(r.url)


def test_given_rules(spark):
    check(spark, URLS + URLS, u.RULES)


def test_split():
    assert u.split_url("x://Ab.C/d/e?f") == ("ab.c", "/d/e") and u.split_url("x://h?p/q") == ("h", "") and u.split_url("x://h#/q") == ("h", "")


@pytest.mark.parametrize("parts", [1, 3])
def test_large_list_is_exact(spark, parts, monkeypatch):
    monkeypatch.setattr(u, "BITS_PER_KEY", 2)  # many false positives, so many levels
    rng = random.Random(parts)
    host = lambda: ".".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(1, 3)))
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((host(), "/" + rng.choice(["", "x", "xy/", "y"])) for _ in range(200))}.values())
    urls = [f"http://{host()}.{host()}/{rng.choice(['', 'x', 'xy/z', 'y?q'])}" for _ in range(1500)]
    check(spark, urls, rules, max_rules=10_000 if parts == 1 else len(rules) // parts + 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.b/c", "kept", "gone")], "page_id long, url string, other string, host string")
    assert u.judge(pages, none).select("other", "host", "rule", "verdict").first() == ("kept", "a.b", None, "allow")
    assert u.judge(pages.limit(0), none).count() == 0
