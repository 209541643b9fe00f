import json
from pathlib import Path

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from shelftally import Lake
from shelftally.operators import channels, comparison, coverage, overlap, provenance
from shelftally.plans import artifacts
from shelftally.plans.artifacts import snapshot_diff, write_artifacts, write_probe
from shelftally.sources.derived import derived_lake

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lake(spark):
    return derived_lake(spark, SF)


def lines(path):
    return [json.loads(line) for f in Path(path).glob("part-*") for line in f.read_text().splitlines()]


def test_writes_every_artifact_and_a_manifest(spark, lake, tmp_path):
    few = [a for a in artifacts.ARTIFACTS if a.name in ("overview", "cataloging_source", "comparison")]
    write_artifacts(lake, str(tmp_path), generated_at="2026-06-01T00:00:00+00:00", artifacts=few)
    totals = lines(tmp_path / "overview" / "totals")
    assert totals == [{"generated_at": "2026-06-01T00:00:00+00:00", "institutions": 25, "records": 1500, "titles": totals[0]["titles"]}]
    assert list(totals[0]) == sorted(totals[0])
    language = lines(tmp_path / "comparison" / "language")
    assert any(r["n"] is None for r in language), "a suppressed cell must stay visible as null"
    manifest = {m["artifact"]: m for m in lines(tmp_path / "manifest")}
    assert set(manifest) == {a.name for a in few}
    assert manifest["comparison"]["threshold"] == 10 and "Language" in {s["label"] for s in manifest["comparison"]["sql"]}
    flow = lines(tmp_path / "cataloging_source" / "flow")
    assert flow and "total" not in flow[0]


def test_parquet_and_unknown_format(spark, lake, tmp_path):
    few = artifacts.ARTIFACTS[1:2]
    write_artifacts(lake, str(tmp_path), fmt="parquet", artifacts=few)
    back = spark.read.parquet(str(tmp_path / "overlap_histogram" / "held_by"))
    assert as_set(back, "institutions", "titles") == as_set(overlap.overlap_histogram(lake), "institutions", "titles")
    with pytest.raises(ValueError, match="unknown artifact format"):
        write_artifacts(lake, str(tmp_path), fmt="xml", artifacts=few)


def test_thirteen_artifacts():
    assert len(artifacts.ARTIFACTS) == 13


def test_published_sql_runs_as_is(spark, lake):
    """Every statement runs in order on a session that only has the input tables."""
    fresh = spark.newSession()
    for name, df in derived_tables(fresh).items():
        df.createOrReplaceTempView(name)
    results = {}
    for artifact in artifacts.ARTIFACTS:
        for label, text in artifact.sql(lake):
            results[artifact.name, label] = fresh.sql(text)
    same = [
        (results["overlap_histogram", "Titles held by N orgs"], overlap.overlap_histogram(lake)),
        (results["overlap_pairwise", "Shared titles of each pair"], overlap.overlap_pairwise(lake)),
        (results["coverage", "Records carrying each field"], coverage.field_counts(lake)),
        (results["cataloging_source", "By year and origin, by agency and its owner, and by depth, in one pass"], provenance.cells(lake)),
        (results["record_channels", "Records carrying each channel's number"], channels.channel_counts(lake)),
        (results["comparison", "Subject class"], lake.sql(comparison.lc_class_sql())),
    ]
    for published, ours in same:
        assert sorted(map(repr, published.collect())) == sorted(map(repr, ours.collect()))


def test_published_sql_runs_on_a_lake_with_its_own_names(spark, lake, tmp_path):
    names = {"tag": "field_tag", "code": "subfield_code", "record_id": "rid"}
    lake.records.withColumnsRenamed(names).write.parquet(f"{tmp_path}/r")
    lake.record_meta.withColumnsRenamed(names).write.parquet(f"{tmp_path}/m")
    own = Lake.read(spark, f"{tmp_path}/r", f"{tmp_path}/m", code_map=lake.code_map, rename={v: k for k, v in names.items()})
    row = artifacts.manifest(own, "now", [a for a in artifacts.ARTIFACTS if a.name == "comparison"]).first()
    fresh = spark.newSession()
    for step in row["sql"]:
        found = fresh.sql(step["sql"])
        if step["label"] == "Language":
            assert sorted(map(repr, found.collect())) == sorted(map(repr, comparison.language_counts(lake).collect()))
    assert row["params"]["now_year"] == "2026" and row["params"]["entered_from"] == "1966"


def test_reports_come_in_reading_order(lake, tmp_path):
    few = [a for a in artifacts.ARTIFACTS if a.name in ("overlap_pairwise", "uniqueness", "publication_decade")]
    write_artifacts(lake, str(tmp_path), artifacts=few)
    pairs = [(-r["shared"], r["a"], r["b"]) for r in lines(tmp_path / "overlap_pairwise" / "pairs")]
    assert pairs == sorted(pairs)
    alone = [(-r["unique_titles"], r["org"]) for r in lines(tmp_path / "uniqueness" / "per_org")]
    assert alone == sorted(alone)
    decades = [(r["org"], r["decade"] or 0) for r in lines(tmp_path / "publication_decade" / "per_org")]
    assert decades == sorted(decades)


def derived_tables(session):
    from shelftally.sources.derived import derived_tables as tables

    return tables(session, SF)


def test_probe_csv(lake, tmp_path):
    write_probe(lake, str(tmp_path / "codes"))
    text = next((tmp_path / "codes").glob("part-*")).read_text().splitlines()
    assert text[0] == "org,code,n,pct_of_org,pct_at_this_org"
    orgs = [line.split(",")[0] for line in text[1:]]
    assert orgs == sorted(orgs) and len(orgs) > 25


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, records long, note string, generated_at string")


def test_snapshot_diff(spark):
    old = table(spark, [("a", 10, None, "1"), ("b", 5, None, "1"), ("b", 5, None, "1")])
    assert snapshot_diff(old, old).isEmpty()
    later = old.withColumn("generated_at", F.lit("2"))
    assert snapshot_diff(old, later).isEmpty()
    real = table(spark, [("a", 11, None, "2"), ("b", 5, None, "2"), ("b", 5, None, "2")])
    assert as_set(snapshot_diff(old, real), "change", "k", "records") == {("-", "a", 10), ("+", "a", 11)}
    zero = table(spark, [("a", 0, None, "2"), ("b", 5, None, "2"), ("b", 5, None, "2")])
    assert ("+", "a", 0) in as_set(snapshot_diff(old, zero), "change", "k", "records")
    fewer = table(spark, [("a", 10, None, "2")])
    assert snapshot_diff(old, fewer).count() == 2
    new = table(spark, [("n", 1, None, "2")])
    assert as_set(snapshot_diff(old.limit(0), new), "change", "k") == {("+", "n")}
    mention = table(spark, [("a", 10, "see generated_at", "1"), ("b", 5, None, "1"), ("b", 5, None, "1")])
    assert snapshot_diff(old, mention).count() == 2


def test_shared_folder_keeps_roll_ups_as_files(spark, tmp_path, monkeypatch):
    from shelftally.sources import derived
    from shelftally.sources import lake as lake_module

    for module in (derived, lake_module):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    stored = derived_lake(spark, SF)
    assert overlap.overlap_histogram(stored).count() > 1
    assert provenance.cataloging_source(stored).count() > 0
    names = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert names == {"derived", "patterns", "cataloging_counts"}
