"""Stored versions of a table compared by digests of their buckets."""

from hypothesis import given, settings
from hypothesis import strategies as st

from shelftally.plans.artifacts import diff_snapshots, snapshot_diff, unequal_buckets, write_snapshot

ROWS = "org string, n long, generated_at string"


def stored(spark, rows, path, stamp, buckets=16):
    frame = spark.createDataFrame([(*r, stamp) for r in rows], ROWS)
    write_snapshot(frame, path, buckets=buckets)
    return frame


def changes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


row = st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 4)))


@settings(max_examples=5, deadline=None)
@given(st.lists(row, max_size=12), st.lists(row, max_size=12))
def test_same_as_the_whole_difference(spark, tmp_path_factory, old, new):
    folder = tmp_path_factory.mktemp("snapshots")
    before = stored(spark, old, f"{folder}/old", "then")
    after = stored(spark, new, f"{folder}/new", "now")
    assert changes(diff_snapshots(spark, f"{folder}/old", f"{folder}/new")) == changes(snapshot_diff(before, after))


def test_only_unequal_buckets_are_read(spark, tmp_path):
    rows = [(f"o{i}", i) for i in range(500)]
    stored(spark, rows, f"{tmp_path}/old", "then", 128)
    stored(spark, [*rows[:-1], ("o499", 500)], f"{tmp_path}/new", "now", 128)
    odd = unequal_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert 1 <= len(odd) <= 2  # where the old row was, and where the new one is
    found = diff_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert changes(found) == [("+", 500, "o499"), ("-", 499, "o499")] or changes(found) == [("+", "o499", 500), ("-", "o499", 499)]
    text = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [" in line and "_bucket" in line.split("PartitionFilters")[1] for line in scans)


def test_equal_versions_read_no_rows(spark, tmp_path):
    rows = [("a", 1), ("a", 1), (None, 2)]
    stored(spark, rows, f"{tmp_path}/old", "then")
    stored(spark, rows[::-1], f"{tmp_path}/new", "now")
    assert unequal_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/new") == []
    assert diff_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new").isEmpty()


def test_a_repeated_row_counts(spark, tmp_path):
    stored(spark, [("a", 1)], f"{tmp_path}/old", "then")
    stored(spark, [("a", 1), ("a", 1)], f"{tmp_path}/new", "now")
    assert len(unequal_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/new")) == 1
    assert diff_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new").count() == 1
