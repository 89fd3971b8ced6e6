import re

from concord.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://COM/x", "https://a.com?x=/en/", "https://EXAMPLE.com/en/1", "https://www.example.com/en/1?q#f", "https://www.example.com/en",
    "https://m.www.example.com/en/", "https://badexample.com/en/", "https://x.net/es/1", "https://x.net/ES/1", "http://net/fr/", "https://example.org/en/", "a://b://com/", "https://user:pw@example.com:80/en/", "https://xn--é.net/fr/é\n", "http://.com/", "http://com./",
]


def brute(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def check(spark, urls, rules, ranges=3):
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge_urls(pages, u.rule_table(spark, rules), ranges=ranges).collect()}
    assert found == {i: brute(x, rules) for i, x in enumerate(urls)}


def test_contract_rules(spark):
    check(spark, URLS, u.RULES)


def test_deep_nesting_and_neighbours(spark):
    rules = [("a.b", "/", "block"), ("b", "/x/y/", "allow"), ("b", "/x", "block"), ("a.b", "/x/y/z", "allow"), ("c.a.b", "/x/", "block"), ("b", "", "allow"), ("ab", "/", "block")]
    hosts = ["b", "a.b", "c.a.b", "d.c.a.b", "xb", "ab", "a.ab", "b.a"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/", "/x/y/z", "/x/y/zz", "/w", "/xx"]
    check(spark, [f"s://{h}{p}" for h in hosts for p in paths], rules)


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/"), (1, "http://x.net/es/"), (None, None)], "page_id long, url string").withColumnsRenamed({}).selectExpr("*", "1 as host", "2 as rule", "3 as stack", "4 as __at", "5 as `a.b`", "6 as URL")
    assert sorted(r["verdict"] for r in u.judge_urls(pages, u.rule_table(spark)).collect()) == ["allow", "block", "block"]
    assert u.judge_urls(pages.limit(0), u.rule_table(spark)).count() == 0
    none = spark.createDataFrame([], u.RULE_SCHEMA)
    assert {r["verdict"] for r in u.judge_urls(pages, none, default="block").collect()} == {"block"}
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("NET", None, "block"), ("net", "", "allow")], u.RULE_SCHEMA)
    assert sorted(r["rule"] or "" for r in u.judge_urls(pages, odd).collect()) == ["", "net", "net"]


def test_random_rules_over_many_ranges(spark):
    import random

    rng = random.Random(15)
    labels, parts = ["a", "b", "co", "x-y", "é"], ["", "a", "a/", "é", "zz/", "b"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choice(parts) for _ in range(rng.randrange(4)))
    for ranges in (1, 7, 40):
        rules = list({(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
        rules = [(h, p, a) for (h, p), a in rules]
        urls = [f"http://{host()}{path()}" for _ in range(400)] + ["http://a.b/a/"] * 100
        check(spark, urls, rules, ranges)


def test_the_plan_does_not_grow_with_nesting(spark):
    pages = spark.createDataFrame([(1, "http://b/" + "x" * 50)], "page_id long, url string")
    sizes = []
    for depth in (2, 40):
        df = u.judge_urls(pages, u.rule_table(spark, [("b", "/" + "x" * k, "block") for k in range(depth)]), ranges=2)
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Window"))
        assert df.first()["rule"] == "b/" + "x" * (depth - 1)
    assert sizes[0] == sizes[1]


def test_very_long_urls(spark):
    long = "x" * 300_000
    check(spark, [f"http://{'a.' * 50_000}example.com/en/{long}", f"http://{long}.net/fr/", f"http://{long}", f"{long}://www.example.com/en/", long], u.RULES)
