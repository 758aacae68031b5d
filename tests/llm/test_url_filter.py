"""URL rules against the plain rule, nested prefixes over many ranges, and edge cases."""

import random
import re

from pyspark.sql import functions as F

from upkeep.llm import url_filter as UF


def plainly(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def held(spark, urls, rules, **more):
    rows = [(i if i % 7 else None, u, 1, "clash") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict int, host string")
    got = sorted((tuple(g) for g in UF.judge_urls(pages, rules, **more).collect()), key=str)
    assert got == sorted(((i, *plainly(u, rules, **more)) for i, u, _, _ in rows), key=str)
    return got


def test_given_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "://", "http://EXAMPLE.org/es/x?y#z", "http://example.org/es", "http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/",
        "http://example.org", "http://example.org?x=/es/", "x://y://example.org/es/", "http://com/fr/", "http://a.com/de/\n/x", "http://É.com/FR/", "http://a..com/fr/é", "http://.org/", "http://org./", "http://a\x01.org/b", "http://a\x01com/fr/", "http://user@a.com:80/fr/",
        "http://long.org/" + "x" * 100_000,
    ]
    got = held(spark, urls, UF.RULES)
    assert {g[4] for g in got} == {"allow", "block"}


def test_nested_rules_over_many_ranges(spark):
    r = random.Random(6)
    part = lambda k: "".join(r.choices("ab", k=r.randint(1, k)))
    host = lambda: ".".join(part(2) for _ in range(r.randint(1, 4)))
    path = lambda: r.choice(["", "/"]) + "/".join(part(3) for _ in range(r.randint(0, 3)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(120))}.values())
    urls = [f"http://{host()}/{part(3)}/{part(3)}{r.choice(['', '?a', '#b', '/c'])}" for _ in range(900)] + ["http://a.b.a/b/a"] * 50
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held(spark, urls, rules, default="block")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_rules_no_pages_and_rules_as_a_table(spark):
    pages = spark.createDataFrame([("p", "http://a.org/x"), ("q", None)], "page_id string, url string")
    assert {tuple(g) for g in UF.judge_urls(pages, []).collect()} == {("p", "a.org", "/x", None, "allow"), ("q", "", "", None, "allow")}
    assert UF.judge_urls(pages.where("false")).count() == 0
    rules = spark.createDataFrame([("ORG", None, "allow"), ("org", "", "block"), ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert {(g.page_id, g.rule, g.verdict) for g in UF.judge_urls(pages, rules).collect()} == {("p", "org", "block"), ("q", None, "allow")}
    assert UF.judge_urls(pages).where(F.col("rule") == "org/").count() == 1
