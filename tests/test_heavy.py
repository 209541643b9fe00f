"""Frequent values by summary and exact count, against counting everything."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelftally.operators import heavy


def brute(rows, k, at_least):
    out = set()
    for group in {g for g, _ in rows}:
        counts = Counter(v for g, v in rows if g == group and v is not None)
        ranked = sorted(((-n, v) for v, n in counts.items() if n >= at_least))[:k]
        out |= {(group, v, -n, place) for place, (n, v) in enumerate(ranked, 1)}
    return out


def tail(groups=3, heavy_values=6, length=3000):
    """A few frequent values over a long tail of values that occur once or twice."""
    rows = []
    for g in range(groups):
        for h in range(heavy_values):
            rows += [(f"g{g}", f"heavy{h}")] * (400 - 31 * h - g)
        rows += [(f"g{g}", f"rare{i % (length - length // 9)}") for i in range(length)]
        rows += [(f"g{g}", None)] * 50
    return rows


@pytest.mark.parametrize(("k", "at_least", "tracked"), [(4, 1, 4096), (4, 10, 512), (12, 10, 1024), (5, 1, 64), (3, 300, 128)])
def test_lists_are_exact_whatever_the_summary_holds(spark, k, at_least, tracked):
    rows = tail()
    frame = spark.createDataFrame(rows, "org string, host string").repartition(5)
    got = {tuple(r) for r in heavy.top_values(frame, "org", "host", k, at_least, tracked).select("org", "host", "n", "place").collect()}
    assert got == brute(rows, k, at_least)


def test_ties_and_small_groups(spark):
    rows = [("a", v) for v in "zyx" for _ in range(3)] + [("b", "one")] + [("c", None)]
    frame = spark.createDataFrame(rows, "org string, host string")
    got = {tuple(r) for r in heavy.top_values(frame, "org", "host", 2).select("org", "host", "n", "place").collect()}
    assert got == {("a", "x", 3, 1), ("a", "y", 3, 2), ("b", "one", 1, 1)}
    assert heavy.top_values(frame.where("false"), "org", "host", 2).count() == 0


def test_the_tail_is_not_shuffled(spark):
    """Candidates are few for each group, bound what they leave out, and are met before any counting."""
    rows = tail()
    frame = spark.createDataFrame(rows, "org string, host string")
    likely = heavy.candidates(frame.where("host IS NOT NULL"), "org", "host", 16, 1024)
    assert likely.count() == 3 * 16
    counts = {(g, v): n for (g, v), n in Counter(rows).items()}
    named = {(r["org"], r["host"]) for r in likely.collect()}
    most = {r["org"]: r["most"] for r in likely.collect()}
    assert all(n <= most[g] for (g, v), n in counts.items() if v is not None and (g, v) not in named)
    met = frame.join(F.broadcast(likely), ["org", "host"]).groupBy("org", "host").count()
    text = met._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_count") < text.index("BroadcastHashJoin")
