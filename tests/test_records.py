import pytest
from conftest import as_dict, as_set, f008

from shelftally import Lake, schema
from shelftally.operators import records


def test_rebuilds_in_order(two_orgs):
    two_orgs.add(
        "penn", "p", ("008", f008()),
        [("245", "a", "Main", "1", "0"), ("245", "b", "sub", "1", "0")],
        ("650", "a", "One"), ("650", "a", "Two"),
    )
    lake = two_orgs.lake()
    row = records.reconstitute(lake, "penn", "penn:p").first()
    assert [f["tag"] for f in row["fields"]] == ["LDR", "008", "245", "650", "650"]
    title = row["fields"][2]
    assert (title["ind1"], title["ind2"], title["value"]) == ("1", "0", None)
    assert [tuple(s) for s in title["subfields"]] == [("a", "Main"), ("b", "sub")]
    assert row["fields"][0]["subfields"] == [] and row["fields"][0]["value"]
    text = records.to_text(records.reconstitute(lake, "penn")).first()["text"].split("\n")
    assert text[0] == "LDR      00000nam a2200000 a 4500"
    assert text[2] == "245 10  $aMain $bsub" and text[3] == "650     $aOne"
    assert records.reconstitute(lake, "penn", "nope").isEmpty()
    assert records.reconstitute(lake).count() == 4


def test_rows_in_any_order_and_missing_parts(spark):
    rows = [
        ("o", "r", "245", 2, None, "0", "b", 1, "second"),
        ("o", "r", "001", 1, None, None, None, None, None),
        ("o", "r", "245", 2, None, "0", "a", 0, "first"),
        ("o", "r", "LDR", 0, None, None, None, None, "leader"),
    ]
    lake = Lake(spark, spark.createDataFrame(rows, schema.RECORDS), spark.createDataFrame([], schema.RECORD_META))
    text = records.to_text(records.reconstitute(lake)).first()["text"]
    assert text == "LDR      leader\n001      \n245  0  $afirst $bsecond"


def test_lookups(two_orgs):
    lake = two_orgs.lake()
    pivot = records.field_pivot(lake, {"title": ("245", "a"), "subject": ("650", "a")})
    assert as_set(pivot, "record_id", "title", "subject") == {
        ("stanford:a1", "Title a1", "Music"),
        ("stanford:a2", "Title a2", None),
        ("harvard:b1", "Title b1", None),
    }
    assert as_dict(records.org_field_count(lake, "245", "a"), "org", "n") == {"stanford": 2, "harvard": 1}
    assert as_dict(records.org_field_count(lake, "245", "a", org="harvard"), "org", "n") == {"harvard": 1}
    assert [r["value"] for r in records.sample_values(lake, "245", "a", 2).collect()] == ["Title b1", "Title a1"]


def test_declared_schema_is_enforced(spark):
    good = spark.createDataFrame([], schema.RECORDS)
    with pytest.raises(schema.SchemaError, match="title_key is missing"):
        Lake(spark, good, spark.createDataFrame([], "org string, record_id string"))
    with pytest.raises(schema.SchemaError, match="record_id is bigint"):
        Lake(spark, good, spark.createDataFrame([], "org string, record_id long, title_key string"))


def test_reads_a_lake_with_other_column_names(spark, tmp_path):
    names = {"rid": "record_id", "field_tag": "tag", "subfield_code": "code", "key": "title_key"}
    recs = spark.createDataFrame([("o", "1", "LDR", 0, None, None, None, None, "x")], schema.RECORDS)
    meta = spark.createDataFrame([("o", "1", "t")], schema.RECORD_META)
    for old, new in names.items():
        recs, meta = recs.withColumnRenamed(new, old), meta.withColumnRenamed(new, old)
    recs.write.partitionBy("org").parquet(str(tmp_path / "records"))
    meta.write.parquet(str(tmp_path / "meta"))
    lake = Lake.read(spark, str(tmp_path / "records"), str(tmp_path / "meta"), rename=names)
    assert lake.records.columns == schema.RECORDS.names
    assert lake.records.first()["tag"] == "LDR" and lake.record_meta.first()["title_key"] == "t"


def test_a_large_lake_is_dealt_over_tasks_by_its_records(spark, shelf, monkeypatch):
    from shelftally.sources import lake as lakes

    for i in range(40):
        shelf.add("penn", f"r{i}", ("245", "a", f"Title {i}", "1", "0"))
    small = shelf.lake()
    assert small.sql(records.NESTED_SQL).count() == 40
    monkeypatch.setattr(lakes, "DEALT_RECORDS", 2)
    large = shelf.lake()
    text = records.reconstitute(large)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and ", 20)" in text
    # one grouping for each record
    assert text.count("ObjectHashAggregate") == 2
    assert sorted(map(tuple, records.to_text(records.reconstitute(large)).collect())) == sorted(map(tuple, records.to_text(records.reconstitute(small)).collect()))
