"""Reading a lake: its own names and types, what it lacks, and what it leaves behind."""

import threading

import pytest
from conftest import Shelf, as_dict, f008

from shelftally import Lake, schema
from shelftally.operators import comparison, overlap, provenance, records
from shelftally.sources.binding import bind
from shelftally.sources.derived import derived_lake


@pytest.fixture
def stored(spark, shelf, tmp_path):
    shelf.add("oak", 1, ("008", f008()), ("245", "a", "One"))
    shelf.add("oak", 2, ("008", f008(lang="ger")), ("245", "a", "Two"))

    def save(names=None, big=False):
        rows = spark.createDataFrame(shelf.rows, schema.RECORDS)
        if big:
            rows = rows.withColumns({c: rows[c].cast("bigint") for c in ("field_seq", "subfield_seq")})
        rows.withColumnsRenamed(names or {}).write.parquet(f"{tmp_path}/r")
        spark.createDataFrame(shelf.meta, schema.RECORD_META).write.parquet(f"{tmp_path}/m")
        return f"{tmp_path}/r", f"{tmp_path}/m"

    return save


def test_missing_columns_are_named(spark, stored):
    paths = stored({"tag": "field_tag", "code": "subfield_code"})
    with pytest.raises(schema.SchemaError) as refused:
        Lake.read(spark, *paths)
    said = str(refused.value)
    assert "no column tag, code" in said and "field_tag" in said and "rename=" in said
    with pytest.raises(schema.SchemaError, match="no column field_tagg"):
        Lake.read(spark, *paths, rename={"field_tagg": "tag", "subfield_code": "code"})


def test_own_names_and_wider_integers(spark, stored):
    paths = stored({"tag": "field_tag", "code": "subfield_code"}, big=True)
    lake = Lake.read(spark, *paths, rename={"field_tag": "tag", "subfield_code": "code"})
    assert dict(lake.records.dtypes)["field_seq"] == "int"
    assert as_dict(comparison.lang_matrix(lake), "category", "total") == {"ENG": 2, "GER": 2}


def test_a_column_of_another_type_is_refused(spark, shelf):
    rows = spark.createDataFrame(shelf.rows, schema.RECORDS)
    with pytest.raises(schema.SchemaError, match="tag is int"):
        Lake(spark, rows.withColumn("tag", rows["field_seq"]), spark.createDataFrame([], schema.RECORD_META))


def test_rows_without_an_id_make_no_record(spark, shelf):
    shelf.add("oak", 1, ("245", "a", "One"), ("100", "a", "Me"))
    shelf.add("elm", 1, ("245", "a", "Other"))
    for i in range(5):
        shelf.rows += [("oak", None, "245", i, " ", " ", "a", 0, "stray"), (None, "x", "245", i, " ", " ", "a", 0, "stray")]
    lake = shelf.lake()
    text = records.to_text(records.reconstitute(lake))
    assert as_dict(text, "record_id", "org") == {"oak:1": "oak", "elm:1": "elm"}
    pivot = records.field_pivot(lake, {"title": ("245", "a"), "author": ("100", "a")})
    assert pivot._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {tuple(r) for r in pivot.collect()} == {("oak:1", "One", "Me"), ("elm:1", "Other", None)}


def test_call_number_positions_of_any_size(shelf):
    low, high = -5, 2**31 - 1

    def held(rid, *places):
        shelf.meta.append(("oak", rid, rid))
        for value, tag, seq, sub in places:
            shelf.rows.append(("oak", rid, tag, seq, " ", " ", "a", sub, value))

    held("a", ("QA1", "050", high, 0), ("M2", "090", 1, 0))  # the location decides before the field
    held("b", ("QA1", "050", 2**24 + 1, 0), ("B1", "050", 2**24, 0))
    held("c", ("QA1", "050", 7, 2), ("D1", "050", 7, low))
    held("d", ("QA1", "050", None, 0), ("E1", "050", high, None))
    held("e", ("F1", "050", None, None))
    got = comparison.lc_class(shelf.lake(threshold=1))
    assert {r["category"]: r["n"] for r in got.collect()} == {"Q": 1, "B": 1, "D": 1, "E": 1, "F": 1}


def names(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith("bound_")}


def test_look_ups_leave_no_view(shelf):
    shelf.add("oak", 1, ("245", "a", "One"))
    lake = shelf.lake()
    start = names(lake.spark)
    records.reconstitute(lake, "oak", "oak:1").collect()
    before = names(lake.spark)
    for i in range(100):
        records.reconstitute(lake, "oak", f"oak:{i}")
    overlap.group_unique(lake, ["oak"]).collect()
    overlap.group_unique(lake, ["oak"]).collect()
    assert len(names(lake.spark) - before) <= 2
    lake.release()
    assert names(lake.spark) <= start


def test_release_leaves_an_empty_shared_folder(spark, tmp_path, monkeypatch):
    for module in ("lake", "derived"):
        monkeypatch.setattr(f"shelftally.sources.{module}.shared_folder", lambda _: str(tmp_path))
    lake = derived_lake(spark, "/root/testdata/sf0.001")
    provenance.cat_mix(lake).count()
    assert list(tmp_path.rglob("*.parquet"))
    lake.release()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_two_names_are_built_at_once(spark):
    lake = Shelf(spark).add("oak", 1).lake()
    meet = threading.Barrier(2, timeout=30)

    def build():
        meet.wait()  # passes only while another build is under way
        return lake.records

    found = []
    both = [threading.Thread(target=lambda n=n: found.append(lake.keep(n, build))) for n in ("a", "b")]
    [t.start() for t in both]
    [t.join() for t in both]
    assert len(found) == 2


def test_table_names_in_sql(spark):
    t = spark.createDataFrame([(1, "FROM t")], "k int, v string")
    assert bind(spark, "SELECT v FROM t WHERE v = 'FROM t' -- FROM t", t=t).first()["v"] == "FROM t"
    assert bind(spark, "SELECT x.k, t.k FROM t x JOIN t ON x.k = t.k", t=t).count() == 1
    assert bind(spark, "WITH a AS (SELECT * FROM t) SELECT a.k FROM a LEFT JOIN t AS b USING (k) ORDER BY 1", t=t).count() == 1
    assert bind(spark, "SELECT t.k FROM t\nGROUP BY t.k", t=t).count() == 1
