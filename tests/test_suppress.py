import pytest
from conftest import as_dict, as_set
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelftally.plans import suppress
from shelftally.plans.matrix import fixed_axis, matrix, share_rows


def counts(spark, rows):
    return spark.createDataFrame(rows, "org string, category string, n long")


def test_top_n_keeps_large_rows_and_sums_the_rest(spark):
    df = counts(spark, [("x", "ginkgo", 40), ("x", "yew", 40), ("x", "larch", 12), ("x", "fir", 11), ("x", "rowan", 2), ("y", "yew", 6), ("y", "fir", 6), ("z", "fir", 60)])
    out = suppress.bucket_top_n(df, n=3, threshold=12, by=["org"])
    assert as_set(out, "org", "category", "n", "cat_rank") == {
        ("x", "ginkgo", 40, 1), ("x", "yew", 40, 2), ("x", "larch", 12, 3), ("x", "Other", 13, 4), ("y", "Other", 12, 4), ("z", "fir", 60, 1),
    }
    assert suppress.small_cells(out, threshold=12).isEmpty()


def test_top_n_without_groups(spark):
    df = counts(spark, [("o", "a", 100), ("o", "b", 50), ("o", "c", 20)])
    assert as_dict(suppress.bucket_top_n(df, n=2, threshold=10), "category", "n") == {"a": 100, "b": 50, "Other": 20}
    assert as_dict(suppress.bucket_top_n(df, n=5, threshold=10), "category", "n") == {"a": 100, "b": 50, "c": 20}
    assert as_dict(suppress.bucket_top_n(df, n=5, threshold=500), "category", "n") == {"Other": 170}


def test_fold_small_ranks_nothing(spark):
    df = counts(spark, [("x", "a", 5), ("x", "b", 4), ("x", "c", 6), ("x", "d", 0)])
    assert as_dict(suppress.fold_small(df, threshold=5), "category", "n") == {"a": 5, "c": 6, "Other": 4}
    assert as_dict(suppress.fold_small(df, threshold=7), "category", "n") == {"Other": 15}


def test_fold_columns_equals_fold_into(spark):
    wide = spark.createDataFrame([(30, 2, 0, 9), (1, 1, 1, 0), (0, 0, 0, 0)], "lc long, pod long, none long, other long")
    got = suppress.fold_columns(wide, ["lc", "pod", "none", "other"], threshold=10).collect()
    assert [tuple(r) for r in got] == [(30, 0, 0, 11), (0, 0, 0, 3), (0, 0, 0, 0)]


def test_fold_into_keeps_the_total(spark):
    df = counts(spark, [("o", "lc", 30), ("o", "pod", 2), ("o", "none", 0), ("p", "other", 3)])
    out = suppress.fold_into(df, threshold=10, by=["org"])
    assert as_set(out, "org", "category", "n") == {("o", "lc", 30), ("o", "other", 2), ("o", "none", 0), ("p", "other", 3)}


def test_leaks_are_found(spark):
    df = counts(spark, [("o", "a", 3), ("o", "Other", 3), ("o", "b", 0), ("o", "c", 10), ("o", None, 4)])
    assert as_set(suppress.small_cells(df, threshold=10), "category") == {("a",), (None,)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.sampled_from("op"), st.sampled_from("abcdef")), st.integers(1, 30), min_size=1), st.integers(1, 4))
def test_top_n_equals_brute_force(spark, cells, n):
    df = counts(spark, [(o, c, v) for (o, c), v in cells.items()])
    want = set()
    for org in {o for o, _ in cells}:
        ranked = sorted(((v, c) for (o, c), v in cells.items() if o == org), key=lambda vc: (-vc[0], vc[1]))
        kept = [(v, c) for v, c in ranked[:n] if v >= 10]
        rest = sum(v for v, _ in ranked) - sum(v for v, _ in kept)
        want |= {(org, c, v) for v, c in kept} | ({(org, "Other", rest)} if rest else set())
    assert as_set(suppress.bucket_top_n(df, n=n, threshold=10, by=["org"]), "org", "category", "n") == want


def test_matrix_axis_totals_and_exclusion(spark):
    df = counts(spark, [("o", "a", 20), ("o", "b", 5), ("p", "a", 10), ("p", "c", 15)])
    rows = {(r["org"], r["category"]): (r["cat_rank"], r["n"], r["total"], r["share"]) for r in matrix(df, 10).collect()}
    assert rows[("o", "b")] == (3, None, 25, None) and rows[("p", "b")] == (3, 0, 25, 0.0)
    assert rows[("o", "a")] == (1, 20, 25, 0.8) and rows[("o", "c")] == (2, 0, 25, 0.0)
    pinned = matrix(df, 10, axis=fixed_axis(spark, ["z", "c"]))
    assert as_set(pinned, "org", "category", "cat_rank", "n") == {("o", "z", 1, 0), ("o", "c", 2, 0), ("p", "z", 1, 0), ("p", "c", 2, 15)}
    kept = share_rows(matrix(df, 10), exclude=["a"])
    assert {r["total"] for r in kept.collect()} == {25} and kept.where("category = 'a'").isEmpty()


def test_equal_totals_rank_by_code(spark):
    df = counts(spark, [("o", "b", 10), ("o", "a", 10), ("o", "c", 11)])
    assert as_dict(matrix(df, 1, top_k=2), "category", "cat_rank") == {"c": 1, "a": 2}
