"""URL rules and lists against plain Python, and the filter's bounds."""

import re
from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelftally.llm import bloom, common, queries, url_filter
from shelftally.llm.url_filter import Rule

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, key string, possible string, block long"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "clash", "clash", 1) for i, u in enumerate(urls)], PAGES)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host) :]).group(), rest


def canonical(url):
    host, path, rest = parts(url)
    if not host:
        return None
    before = rest.split("#", 1)[0]
    query = before.split("?", 1)[1] if "?" in before else ""
    kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|gclid|fbclid|ref)(=|$)", p))
    site = re.sub(r"^(www|m)\.", "", re.sub(r":(80|443)$", "", host))
    return site + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def expected(urls, listed, rules):
    names = {canonical(u) for u in listed} - {None}
    for i, url in enumerate(urls):
        host, path, _ = parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.host + r.path), default=None)
        verdict = best.verdict if best else "block" if canonical(url) in names else "allow"
        yield i, host, path, best and best.host + best.path, verdict


def judged(spark, urls, listed, rules):
    got = url_filter.judge(pages(spark, urls), pages(spark, listed).drop("key"), rules)
    return sorted(tuple(r)[:5] for r in got.collect())


HOSTS = ["a.org", "EXAMPLE.org", "x.example.org", "notexample.org", "org", "www.b.com", "m.b.com", "b.com", "b.com:80", "", "é.Com"]
PATHS = ["", "/", "/es/1", "/en/1", "/en/12/", "/en/2", "/fr/", "/FR/", "/de/x", "//", "/a b\nc"]
TAILS = ["", "?", "#", "?a=1&b=2", "?b=2&a=1#x", "?utm_source=f&a=1&b=2", "#?a=1", "?ref", "?reference=1", "?x=://"]
urls = st.one_of(
    st.builds(lambda s, h, p, t: s + h + p + t, st.sampled_from(["http://", "https://", "x://", "//", ""]), st.sampled_from(HOSTS), st.sampled_from(PATHS), st.sampled_from(TAILS)),
    st.sampled_from([None, "", "://", "a://", "://://x", "http:///p", "http://?q", "no address"]),
)


@settings(max_examples=12, deadline=None)
@given(st.lists(urls, min_size=1, max_size=40), st.lists(urls, max_size=15))
def test_verdicts(spark, seen, listed):
    assert judged(spark, seen, listed, url_filter.RULES) == sorted(expected(seen, listed, url_filter.RULES), key=lambda r: r[0])


def test_host_and_path_as_a_parser_has_them(spark):
    url = "https://Blog.Example.com/a/b?c=1#d"
    got = spark.range(1).select(url_filter.host(F.lit(url)), url_filter.path(F.lit(url))).first()
    assert tuple(got) == (urlsplit(url).hostname, urlsplit(url).path)


def test_longest_rule_and_ties(spark):
    rules = [Rule("allow", "com", "/ab"), Rule("block", "b.com", "/"), Rule("block", "com", "/"), Rule("allow", "b.com", "/abc")]
    seen = ["http://b.com/abcd", "http://b.com/abx", "http://c.com/ab", "http://c.com", "http://xb.com/q"]
    assert judged(spark, seen, [], rules) == sorted(expected(seen, [], rules))
    assert judged(spark, seen, [], [])[0][3:] == (None, "allow")
    with pytest.raises(ValueError, match="at most"):
        url_filter.longest_rule([Rule("allow", str(i), "/") for i in range(1001)], F.lit(""), F.lit(""))


def test_defined_cases(spark):
    twice = spark.createDataFrame([(None, "http://a.net/x"), (None, "http://a.net/x"), (1, None), (1, "http://m.a.net/x/#y")], "page_id long, url string")
    listed = spark.createDataFrame([("https://www.a.net/x?ref=1",), (None,), ("https://a.net/x",)], "url string")
    got = sorted((r["page_id"] is None, r["verdict"]) for r in url_filter.judge(twice, listed).collect())
    assert got == [(False, "allow"), (False, "block"), (True, "block"), (True, "block")]
    assert url_filter.judge(twice.where("false"), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(twice, listed.where("false")).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://a.net/" + "y" * 500_000 + "?" + "&".join(f"k{i}" for i in range(2000)))], "page_id long, url string")
    row = url_filter.judge(long, long.select("url")).first()
    assert row["verdict"] == "block" and len(row["path"]) == 500_001


def test_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert bloom.with_passes(keys, "key", keys, "possible").where("NOT possible").count() == 0
    assert bloom.with_passes(others, "key", keys, "possible").where("possible").count() < 200
    assert bloom.blocks_for(10**10) == bloom.MOST_BLOCKS and bloom.blocks_for(0) == 1


def test_a_full_filter_still_gives_exact_verdicts(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 1)
    seen = [f"http://a.net/{i}" for i in range(3000)]
    got = {r[0] for r in judged(spark, seen, seen[::3], []) if r[4] == "block"}
    assert got == set(range(0, 3000, 3))


def test_a_hot_key_is_dealt_over_places(spark):
    rows = common.cut(spark.range(30_000).select("id", F.when(F.col("id") < 20_000, "hot").when(F.col("id") < 25_000, F.concat(F.lit("k"), "id")).alias("k"), F.lit(1).alias("salt")))
    facts = spark.createDataFrame([("hot", 1), ("k21000", 2), ("absent", 3)], "k string, fact int")
    joined = common.join_hot(rows, facts, "k", F.col("id"))
    assert joined.columns == ["k", "id", "salt", "fact"]
    assert {(r["fact"], r["count"]) for r in joined.groupBy("fact").count().collect()} == {(1, 20_000), (2, 1), (None, 9_999)}


def test_query_stays_native_and_reads_two_columns(spark):
    frame = queries.op11_url_filter(spark, SF)
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("== Optimized Logical Plan ==")[1].split("ReadSchema")[-1]
    assert frame.count() == 250
