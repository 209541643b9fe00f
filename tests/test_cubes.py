"""Elected attributes of titles, and cubes of holding patterns."""

import pytest
from conftest import f008
from pyspark.sql import functions as F

from shelftally.operators import cubes, overlap
from shelftally.sources.derived import derived_lake

SF = "/root/testdata/sf0.001"
MAP, BOOK = "00000nem a2200000 a 4500", "00000nam a2200000 a 4500"


@pytest.fixture(scope="module")
def lake(spark):
    return derived_lake(spark, SF)


def test_the_value_of_most_records_is_elected_and_the_least_of_equal_ones(shelf):
    shelf.add("a", "1", ("008", f008(date1="1990", lang="fre")), leader=MAP, title="t")
    shelf.add("b", "1", ("008", f008(date1="1985", lang="eng")), leader=BOOK, title="t")
    shelf.add("b", "2", ("008", f008(date1="1987", lang="   ")), leader=BOOK, title="t")
    shelf.add("c", "1", ("008", f008(date1="19uu", lang="ger")), leader=MAP, title="u")
    shelf.add("c", "2", leader=MAP, title="v")
    rows = {tuple(r[a] for a in cubes.ATTRIBUTES): (r["titles"]) for r in cubes.title_facets(shelf.lake()).collect()}
    assert rows == {(1980, "ENG", "a"): 1, (None, "GER", "e"): 1, (None, None, "e"): 1}


def test_the_first_field_of_a_record_counts(shelf):
    shelf.add("a", "1", ("008", f008(date1="1950")), ("008", f008(date1="2001")), title="t")
    assert [r["decade"] for r in cubes.title_facets(shelf.lake()).collect()] == [1950]


def test_every_margin_adds_up(lake):
    whole = overlap.corpus_totals(lake).first()["titles"]
    rows = cubes.pattern_cube(lake)
    sums = {r["parts"]: r["n"] for r in rows.groupBy("parts").agg(F.sum("titles").alias("n")).collect()}
    assert sums == {parts: whole for parts in range(8)}
    patterns = {(tuple(r["holders"]), r["titles"]) for r in rows.where("parts = 0").collect()}
    keyed = overlap.patterns(lake).where("keyed").count()
    assert len(patterns) == keyed


def test_folding_loses_no_title_and_shows_no_small_cell(lake):
    rows = cubes.pattern_cube_folded(lake).collect()
    assert sum(r["titles"] for r in rows) == overlap.corpus_totals(lake).first()["titles"]
    assert all(r["titles"] >= lake.params.threshold for r in rows if r["depth"])
    assert all((r["holders"] is None) == (r["depth"] == 0) for r in rows)
    assert all(r["format"] is None for r in rows if r["depth"] < 4) and {r["depth"] for r in rows} >= {0}


def test_titles_of_a_group_by_attribute(shelf):
    shelf.add("a", "1", ("008", f008(date1="1890")), title="old")
    shelf.add("a", "2", ("008", f008(date1="1891")), title="both")
    shelf.add("b", "1", ("008", f008(date1="1891")), title="both")
    shelf.add("c", "1", ("008", f008(date1="1892")), title="old")
    shelf.add("b", "2", ("008", f008(date1="2010")), title="new")
    lake = shelf.lake()
    got = {(r["org"], r["decade"]): r["titles"] for r in cubes.group_unique_by(lake, ["a", "b"], "decade").collect()}
    assert got == {("a", 1890): 1, ("b", 2010): 1}
    with pytest.raises(ValueError, match="none of"):
        cubes.group_unique_by(lake, ["a"], "title")
    with pytest.raises(ValueError, match="not in the lake"):
        cubes.group_unique_by(lake, ["a", "z"], "decade")


def test_titles_are_shuffled_once(lake):
    text = lake.sql(cubes.facets_sql(lake.org_count), roster=lake.roster, record_attributes=lake.sql(cubes.attributes_sql(lake.params)))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(title_key") == 1 and "partial_mode" in plan
