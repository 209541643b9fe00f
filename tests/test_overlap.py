from collections import Counter, defaultdict
from itertools import combinations

import pytest
from conftest import as_dict, as_set
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelftally import Lake, schema
from shelftally.operators import overlap


def test_two_orgs(two_orgs):
    import datetime

    lake = two_orgs.lake(harvest=[("harvard", datetime.datetime(2026, 1, 2))])
    assert overlap.corpus_totals(lake).first().asDict() == {"records": 3, "titles": 2, "institutions": 2}
    per_org = {r["org"]: r for r in overlap.org_totals(lake).collect()}
    assert (per_org["stanford"]["records"], per_org["stanford"]["titles"]) == (2, 2)
    assert per_org["stanford"]["last_sync"] is None
    assert per_org["harvard"]["last_sync"] == datetime.datetime(2026, 1, 2)
    assert as_dict(overlap.overlap_histogram(lake), "institutions", "titles") == {1: 1, 2: 1}
    assert as_set(overlap.overlap_pairwise(lake), "a", "b", "shared") == {("harvard", "stanford", 1)}
    assert as_dict(overlap.org_titles(lake), "org", "titles") == {"harvard": 1, "stanford": 2}
    assert as_dict(overlap.uniqueness(lake), "org", "unique_titles") == {"stanford": 1}


def test_without_sync_table(two_orgs):
    rows = overlap.org_totals(two_orgs.lake()).collect()
    assert all(r["last_sync"] is None for r in rows)


def brute(meta):
    held = defaultdict(set)
    for org, _, title in meta:
        held[title].add(org)
    keyed = {t: o for t, o in held.items() if t is not None}
    pairs = Counter(p for orgs in keyed.values() for p in combinations(sorted(orgs), 2))
    return {
        "totals": (len(meta), len(keyed), len({m[0] for m in meta})),
        "histogram": dict(Counter(len(o) for o in held.values())),
        "titles": dict(Counter(o for orgs in keyed.values() for o in orgs)),
        "unique": dict(Counter(next(iter(o)) for o in held.values() if len(o) == 1)),
        "pairs": {(*p, n) for p, n in pairs.items()},
    }


def lake_of(spark, meta):
    return Lake(
        spark,
        spark.createDataFrame([], schema.RECORDS),
        spark.createDataFrame(meta, schema.RECORD_META),
    )


def measured(lake):
    totals = overlap.corpus_totals(lake).first()
    titles = as_dict(overlap.org_titles(lake), "org", "titles")
    return {
        "totals": tuple(totals),
        "histogram": as_dict(overlap.overlap_histogram(lake), "institutions", "titles"),
        "titles": {o: n for o, n in titles.items() if n},
        "unique": as_dict(overlap.uniqueness(lake), "org", "unique_titles"),
        "pairs": as_set(overlap.overlap_pairwise(lake), "a", "b", "shared"),
    }


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from("abcde"), st.sampled_from([None, "t1", "t2", "t3", "t4", "t5"])),
        min_size=1,
        max_size=40,
    )
)
def test_equals_brute_force(spark, held):
    meta = [(org, f"{org}:{i}", title) for i, (org, title) in enumerate(held)]
    lake = lake_of(spark, meta)
    assert measured(lake) == brute(meta)
    lake.release()


def test_hot_title_and_hot_org(spark):
    orgs = ["big"] * 5 + ["b", "c", "d", "e"]
    meta = [
        (orgs[i % 9], f"{i}", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"t{i % 400}")
        for i in range(3000)
    ]
    assert measured(lake_of(spark, meta)) == brute(meta)


def test_more_orgs_than_one_word_holds(spark):
    orgs = [f"org{i:03d}" for i in range(70)]
    meta = [(o, f"{o}:{t}", f"t{t}") for i, o in enumerate(orgs) for t in range(6) if (i * 7 + t) % 5 < 2]
    meta += [(o, f"{o}:all", "everywhere") for o in orgs]
    lake = lake_of(spark, meta)
    assert overlap.masks(lake.org_count) == ["mask_0", "mask_1"]
    assert measured(lake) == brute(meta)
    widest = max(overlap.holding_patterns(lake).collect(), key=lambda r: r["n_holders"])
    assert widest["holders"] == orgs


def test_patterns_and_groups(spark):
    meta = [("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x"), ("a", "4", "y"), ("b", "5", "y"), ("a", "6", "z"), ("c", "7", "w")]
    lake = lake_of(spark, meta)
    patterns = {tuple(r["holders"]): r["titles"] for r in overlap.holding_patterns(lake).collect()}
    assert patterns == {("a", "b", "c"): 1, ("a", "b"): 1, ("a",): 1, ("c",): 1}
    assert as_dict(overlap.group_overlap(lake, ["a", "b"]), "held_by", "titles") == {1: 1, 2: 2}
    assert overlap.group_shared(lake, ["a", "b"]).first()["titles"] == 2
    assert as_dict(overlap.group_unique(lake, ["a", "b"]), "org", "titles") == {"a": 1, "b": 0}
    folded = as_set(overlap.holding_patterns(lake, fold_rare=True), "holders", "n_holders", "titles")
    assert folded == {(None, 1, 2), (None, 2, 1), (None, 3, 1)}
    with pytest.raises(ValueError, match="nowhere"):
        overlap.group_shared(lake, ["a", "nowhere"])


def test_group_unique_query_lists_only_orgs_with_titles_of_their_own(spark):
    import __spark_entry__ as entry

    shared = [(org, f"{org}:1", "x") for org in entry.GROUP]
    query = entry.OPERATORS["group_unique"]
    assert query(lake_of(spark, shared)).collect() == []
    alone = [*shared, ("nation_2", "nation_2:2", "y")]
    assert as_dict(query(lake_of(spark, alone)), "org", "titles") == {"nation_2": 1}


def test_similarity(spark):
    meta = [("a", "1", "x"), ("a", "2", "y"), ("a", "3", "z"), ("b", "4", "x"), ("c", "5", "q")]
    lake = lake_of(spark, meta)
    assert as_set(overlap.jaccard(lake), "a", "b", "jaccard") == {("a", "b", 1 / 3), ("a", "c", 0.0), ("b", "c", 0.0)}
    got = {(r["a"], r["b"]): r["containment"] for r in overlap.containment(lake).collect()}
    assert got[("a", "b")] == 1 / 3 and got[("b", "a")] == 1.0 and len(got) == 6
    best = overlap.closest_pairs(lake, "containment").collect()
    assert [(r["a"], r["b"]) for r in best][:2] == [("b", "a"), ("a", "b")]
    matrix = {(r["a"], r["b"]): r["value"] for r in overlap.similarity_matrix(lake).collect()}
    assert len(matrix) == 9 and matrix[("a", "a")] is None and matrix[("b", "a")] == 1 / 3


def test_invariants(spark):
    from shelftally.sources.derived import derived_lake

    lake = derived_lake(spark, "/root/testdata/sf0.001")
    # records without a title share one row of the curve, but are no title of an org
    lake = Lake(spark, lake.records, lake.record_meta.where("title_key IS NOT NULL"))
    held = as_dict(overlap.overlap_histogram(lake), "institutions", "titles")
    titles = as_dict(overlap.org_titles(lake), "org", "titles")
    assert sum(k * n for k, n in held.items()) == sum(titles.values())
    assert sum(held.values()) == overlap.corpus_totals(lake).first()["titles"]
    assert sum(as_dict(overlap.uniqueness(lake), "org", "unique_titles").values()) == held[1]
