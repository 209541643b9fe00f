"""
URL filters: rules by host and path, and a blocked Bloom filter before an exact join.

Listed URLs are kept under a canonical form. Their Bloom filter (``bloom``) is small enough to
be sent to every task and passes possible hits only; these meet the list in a hash join on the
canonical form, which removes false positives. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bloom import with_passes

#: Query parameters that do not change the page.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
#: Rules are a policy that people write; they travel in the plan.
MOST_RULES = 1000
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one, or for a null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Up to the first ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), letters, letters.lower())


def path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One form for the addresses of a page; null without a host.

    The scheme, a leading ``www.`` or ``m.``, a standard port, slashes at the end of the path,
    tracking parameters and the fragment go; the other parameters are sorted.
    """
    site = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host(url) != "", F.concat(site, F.rtrim(path(url), F.lit("/")), asked))


def _suffixes(name: Column) -> Column:
    """A host and the domains that it belongs to."""
    labels = F.split(name, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def longest_rule(rules: Sequence[Rule], of_host: Column, of_path: Column) -> Column:
    """A struct ``rule``, ``verdict`` of the longest rule that fits, or null.

    A rule fits its host and all subdomains where the path starts with its own. Of rules of
    one length that with the longer host wins, then the last by text.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit into a plan, list URLs instead")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")

    def entry(rule: Rule) -> Column:
        text = rule.host + rule.path
        size = F.struct(F.lit(len(text)).alias("all"), F.lit(len(rule.host)).alias("host"))
        return F.struct(size.alias("size"), *(F.lit(v).alias(k) for k, v in (("rule", text), ("verdict", rule.verdict), ("host", rule.host), ("path", rule.path))))

    domains = _suffixes(of_host)
    fits = F.filter(
        F.array(*map(entry, rules)), lambda r: F.array_contains(domains, r["host"]) & F.startswith(of_path, r["path"])
    )
    best = F.array_max(fits)
    return F.when(F.size(fits) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """Every row of ``pages`` (``page_id``, ``url``) with its verdict.

    ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``canonical``. A rule that fits
    decides; other rows are blocked where their canonical URL is that of a row of ``listed``
    (``url``), else allowed. A null url, or one without ``://``, has an empty host and path,
    and is allowed unless a rule fits. Repeated rows come out as often, a null id is an id as
    any other, repeats in the list count once, and other columns are not read. An empty list
    blocks nothing.
    """
    keys = common.cut(listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct())
    rows = pages.select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        canonical(F.col("url")).alias("key"),
        longest_rule(rules, host(F.col("url")), path(F.col("url"))).alias("ruled"),
    )
    open_to_list = F.col("ruled").isNull() & F.col("key").isNotNull()
    asked = with_passes(rows.withColumn("key", F.when(open_to_list, F.col("key"))), "key", keys, "possible")
    columns = ["page_id", "host", "path", "ruled", "possible", "key"]
    # possible hits alone are shuffled; a URL that many of them share is dealt over salts
    hits = common.cut(asked.where("possible").select(*columns))
    exact = common.join_hot(hits, keys.withColumn("listed", F.lit(True)), "key", F.xxhash64("page_id", "host", "path"))
    rest = asked.where("NOT possible").select(*columns, F.lit(None).cast("boolean").alias("listed"))
    method = F.when(F.coalesce("listed", F.lit(False)), BLOCK).otherwise(ALLOW)
    return exact.select(*columns, "listed").unionAll(rest).select(
        "page_id",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", method).alias("verdict"),
        "possible",
    )


# -- the query's rules and list ---------------------------------------------------------

#: Fixed values of the query.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)
REPORTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def reported(pages: DataFrame) -> DataFrame:
    """The list of the query: ``url`` of every page on a host with a name reported for spam or adverts."""
    return pages.select("url").where(F.arrays_overlap(F.split(host(F.col("url")), r"\."), F.array(*map(F.lit, REPORTED_NAMES))))
