from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import judge


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"] or [len(tail)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_equals_brute_force(spark):
    urls = [None, "", "no scheme/at all", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://x.example.org/en/2",
            "https://notexample.org/es/", "https://a.com/fr/", "https://com/de/x", "ftp://b.a.com/de", "http://a.com?/fr/", "http://a.com#/fr/", "http://É.com/de/é", "x://y://z.org/",
            "http://a..org/", "http://.org/", "http://user@h.org:80/", "http://" + "s." * 3000 + "org/" + "p/" * 3000, "http://ex.org/\nline", "http://ex.org/\nline"]
    rules = URL_RULES + [("block", "ex.org", ""), ("allow", "ex.org", ""), ("block", "ORG", "/p/p/"), (None, "com", "/"), ("block", None, "/"), ("block", "com", None), ("block", "", "/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[6], "h", "r")] * 2, "page_id long, url string, host string, rule string")
    got = judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    real = [(v, "".join(c.lower() if c.isascii() else c for c in h), p) for v, h, p in rules if v and h and p is not None]
    assert sorted(map(tuple, got), key=str) == sorted([(i, *brute(u, real)) for i, u in enumerate(urls)] + [(None, *brute(urls[6], real))] * 2, key=str)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    assert judge(pages.limit(0), rules).collect() == []
    assert [tuple(r) for r in judge(pages, rules.limit(0)).collect()] == [(1, "a.org", "/x", None, "allow")]
