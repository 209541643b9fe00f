"""Bounds against every solution that exists, and the second pass against a reader who knows how it works."""

from dataclasses import replace
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelftally.plans import artifacts, disclosure
from shelftally.plans.matrix import matrix

CELLS = "cell string, low long, high long"
TERMS = "relation string, cell string, sign int"
RELATIONS = "relation string, least long, most long"
ROWS = "report string, org string, category string, n long, total long, whole boolean"


def tightened(spark, cells, terms, relations):
    out = disclosure.propagate(spark.createDataFrame(cells, CELLS), spark.createDataFrame(terms, TERMS), spark.createDataFrame(relations, RELATIONS))
    return {r["cell"]: (r["low"], r["high"]) for r in out.collect()}


def test_two_margins_give_away_what_one_does_not(spark):
    """A 2 x 2 table with three hidden cells: neither a row nor a column alone tells them, both do."""
    cells = [("a", 1, 9), ("b", 1, 9), ("c", 1, 9), ("d", 20, 20)]
    rows = [("r1", "a", 1), ("r1", "b", 1), ("r2", "c", 1), ("r2", "d", 1)]
    columns = [("c1", "a", 1), ("c1", "c", 1), ("c2", "b", 1), ("c2", "d", 1)]
    of_rows = [("r1", 7, 7), ("r2", 23, 23)]
    assert tightened(spark, cells, rows, of_rows)["a"] == (1, 6)
    both = tightened(spark, cells, rows + columns, [*of_rows, ("c1", 5, 5), ("c2", 25, 25)])
    assert both == {"a": (2, 2), "b": (5, 5), "c": (3, 3), "d": (20, 20)}


def test_a_part_is_no_larger_than_its_whole(spark):
    cells = [("part", 1, 9), ("whole", 1, 9), ("other", 1, 9), ("open", 0, None)]
    terms = [("sum", "whole", 1), ("sum", "other", 1), ("within", "whole", 1), ("within", "part", -1), ("free", "part", 1), ("free", "open", 1)]
    got = tightened(spark, cells, terms, [("sum", 3, 3), ("within", 0, None), ("free", 12, 12)])
    assert got == {"part": (1, 2), "whole": (1, 2), "other": (1, 2), "open": (10, 11)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=1, max_size=4), st.integers(0, 2))
def test_one_sum_is_tightened_to_the_end(spark, drawn, slack):
    """With one relation the bounds are exactly those of the solutions."""
    cells = [(str(i), 1 if hidden else v, 4 if hidden else v) for i, (v, hidden) in enumerate(drawn)]
    total = sum(max(1, min(4, v)) if hidden else v for v, hidden in drawn)
    got = tightened(spark, cells, [("sum", c[0], 1) for c in cells], [("sum", total - slack, total)])
    solutions = [s for s in product(*(range(low, high + 1) for _, low, high in cells)) if total - slack <= sum(s) <= total]
    assert got == {str(i): (min(s[i] for s in solutions), max(s[i] for s in solutions)) for i in range(len(cells))}


def solutions(cells, total, whole, threshold, withheld):
    """Every reading of a row of cells that fits its total."""
    ranges = []
    for n, why in zip(cells, withheld, strict=True):
        ranges.append([n] if n is not None else range(threshold, (total or 99) + 1) if why == "beside" else range(1, threshold))
    for s in product(*ranges):
        if total is None or sum(s) == total or (not whole and sum(s) < total):
            yield s


counts = st.lists(st.integers(0, 8), min_size=1, max_size=4)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(counts, st.booleans(), st.integers(0, 3)), min_size=1, max_size=4))
def test_nothing_can_be_worked_out_after_the_second_pass(spark, orgs):
    threshold = 4
    rows = []
    for i, (cells, whole, tail) in enumerate(orgs):
        total = sum(cells) + (0 if whole else tail)
        rows += [("r", f"o{i}", f"c{j}", n if n == 0 or n >= threshold else None, total, whole) for j, n in enumerate(cells)]
    frame = spark.createDataFrame(rows, ROWS)
    told = disclosure.bounds(frame, threshold).collect()
    for org in {r["org"] for r in told}:
        mine = sorted((r for r in told if r["org"] == org), key=lambda r: r["category"])
        found = list(solutions([r["n"] for r in mine], mine[0]["total"], mine[0]["whole"], threshold, [None] * len(mine)))
        for i, r in enumerate(mine):
            assert (r["low"], r["high"]) == (min(s[i] for s in found), max(s[i] for s in found))
    guarded = disclosure.protect(frame, threshold)
    after = guarded.collect()
    before = {(r[1], r[2]): r for r in rows}
    for org in {r["org"] for r in after}:
        mine = sorted((r for r in after if r["org"] == org), key=lambda r: r["category"])
        found = list(solutions([r["n"] for r in mine], mine[0]["total"], mine[0]["whole"], threshold, [r["withheld"] for r in mine]))
        for i, r in enumerate(mine):
            assert r["n"] in (None, before[r["org"], r["category"]][3])
            assert r["n"] is not None or len({s[i] for s in found}) > 1
        assert sum(r["withheld"] == "beside" for r in mine) <= 1
    assert not [r for r in disclosure.bounds(guarded, threshold).collect() if r["n"] is None and r["low"] == r["high"]]


def test_a_row_that_gives_nothing_away_is_left_alone(spark):
    rows = [("r", "o", "a", None, 60, True), ("r", "o", "b", None, 60, True), ("r", "o", "c", 50, 60, True), ("r", "p", "a", 0, 30, True), ("r", "p", "b", 30, 30, True)]
    out = disclosure.protect(spark.createDataFrame(rows, ROWS), 10)
    assert {(r["org"], r["category"], r["n"], r["total"]) for r in out.collect()} == {(o, c, n, t) for _, o, c, n, t, _ in rows}


def test_shares_follow_their_counts(spark):
    counts = spark.createDataFrame([("o", "a", 3), ("o", "b", 20), ("o", "c", 40), ("p", "a", 5)], "org string, category string, n long")
    out = {(r["org"], r["category"]): (r["n"], r["total"], r["share"]) for r in disclosure.protected(matrix(counts, 10), 10).collect()}
    assert out["o", "a"] == (None, 63, None) and out["o", "b"] == (None, 63, None) and out["o", "c"] == (40, 63, 40 / 63)
    assert out["p", "a"] == (None, None, None) and out["p", "b"] == (0, None, None)


def test_nothing_published(spark):
    none = spark.createDataFrame([], ROWS)
    assert disclosure.bounds(none, 10).count() == 0 and disclosure.protect(none, 10).count() == 0
    assert disclosure.propagate(none.select(F.lit("x").alias("cell"), F.lit(1).alias("low"), F.lit(2).alias("high")), spark.createDataFrame([], TERMS), spark.createDataFrame([], RELATIONS)).count() == 0


def test_artifacts_with_a_second_pass(spark, shelf, tmp_path):
    """Three theses beside many maps: the maps go with them, and nothing else does."""
    for i in range(15):
        leader = f"00000n{'t' if i < 3 else 'e'}m a2200000 a 4500"
        shelf.add("x", f"r{i}", leader=leader)
    comparison = [a for a in artifacts.ARTIFACTS if a.name == "comparison"]
    only = [replace(a, sections={"record_type": a.sections["record_type"]}) for a in comparison]
    for second_pass, want in ((False, {("t", None), ("e", 12)}), (True, {("t", None), ("e", None)})):
        out = str(tmp_path / str(second_pass))
        artifacts.write_artifacts(shelf.lake(), out, artifacts=only, second_pass=second_pass)
        rows = spark.read.json(f"{out}/comparison/record_type", schema="category string, n long, total long").collect()
        assert {(r["category"], r["n"]) for r in rows} == want and {r["total"] for r in rows} == {15}
