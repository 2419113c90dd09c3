import random

from kmerlake.llm.urls import judge_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("a.b.net", "", "block"), ("b.net", "/es/x", "allow"), ("b.net", "/es/x", "block"), ("example.com", "/en/a", "allow")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def urls():
    rng = random.Random(4)
    hosts = ["com", "example.com", "WWW.Example.com", "x.www.example.com", "net", "a.b.net", "b.net", "xexample.com", "", "example.com:80",
             "com\x01", "ÀB.com", "..com"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/en/ab?q=/es/", "/es/", "/es/x/y#z", "?a=b", "#f", "/\n/"]
    found = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    return [*found, None, "", "no scheme", "http://a/://b", "http://example.com/en/" + "x" * 20000] + ["https://example.com/en/a"] * 50


def test_equals_brute_force(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    given = urls()
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(given)], "page_id long, url string, host string, Verdict string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()}
    assert rows == {i: brute(u, RULES) for i, u in enumerate(given)}


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [r["verdict"] for r in judge_urls(pages, rules.limit(0), default="block").collect()] == ["block"]


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    given = ["http://" + "a." * 100_000 + "net/es/", "http://" + "x." * 50_000 + "www.example.com/en/", "http://" + "." * 60_000]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()}
    assert rows == {i: brute(u, RULES) for i, u in enumerate(given)}
