"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from shelftally.operators import channels, comparison, coverage, overlap, provenance, serials
from shelftally.sources.derived import stored_lake, write_derived

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("lake"))
    write_derived(spark, SF, out)
    return stored_lake(spark, out)


@pytest.mark.parametrize("name", sorted(entry.OPERATORS | entry.PLANTED))
def test_no_python_and_no_product_in_any_query(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for banned in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in text, f"{name}: {banned}"


def test_kept_results_are_read_from_the_cache(spark, stored):
    for text, extra in (
        (overlap.pattern_sql(25), {"roster": stored.roster}),
        (provenance.CELLS_SQL, {"cataloging_source": provenance.cataloging_source(stored)}),
    ):
        assert "InMemoryTableScan" in plan(stored.sql(text, **extra))
        assert "InMemoryTableScan" in plan(stored.sql(text, **extra))


def test_release_leaves_nothing_behind(spark, tmp_path):
    write_derived(spark, SF, str(tmp_path))
    before = {t.name for t in spark.catalog.listTables()}
    lake = stored_lake(spark, str(tmp_path))
    overlap.overlap_histogram(lake).count()
    provenance.cat_mix(lake).count()
    lake.release()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert overlap.overlap_histogram(lake).count() > 1


def test_tag_filter_reaches_the_scan(stored):
    text = plan(stored.sql(comparison.RECORD_TYPE_SQL))
    assert "EqualTo(tag,LDR)" in text
    assert "ReadSchema: struct<tag:string,value:string>" in text


def test_field_008_is_read_once(stored):
    from shelftally.operators import archives, fixed_fields

    text = plan(stored.sql(fixed_fields.FIXED_SQL))
    assert "In(tag, [008,LDR])" in text and text.count("Exchange hashpartitioning(org") == 3
    fixed_fields.fixed_fields(stored).count()
    reports = (comparison.lang_matrix, comparison.country_matrix, comparison.publication_decade, archives.archive_decade)
    for report in (*reports, serials.serials_active, serials.serials_start_decade, serials.serial_status):
        assert "EqualTo(tag,008)" not in plan(report(stored))


def test_leaders_that_tell_nothing_are_not_grouped(stored):
    from shelftally.operators import fixed_fields

    text = plan(stored.sql(fixed_fields.FIXED_SQL))
    assert any("Filter" in line and "substring(value" in line for line in text.splitlines())


def test_overlap_never_reads_subfields(stored):
    text = plan(stored.sql(overlap.pattern_sql(25), roster=stored.roster))
    assert "record_meta" in text and "/records]" not in text
    outer = text.split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in outer and outer.count("Exchange hashpartitioning") == 2


def test_roll_up_shuffles_records_once(stored):
    text = plan(stored.sql(provenance.counts_sql(stored.params)))
    assert text.count("Exchange hashpartitioning(h#") == 1 and "Join" not in text
    # besides it only the counts of rows without a record id and the roll-up itself
    assert text.count("Exchange ") == 3


def test_rows_of_a_record_pass_two_aggregates(stored):
    """Agencies are collected: counted as DISTINCT, they take every row through four sorted aggregates."""
    text = plan(stored.sql(provenance.counts_sql(stored.params)))
    assert "SortAggregate" not in text and text.count("ObjectHashAggregate") == 2


def test_call_numbers_and_coverage_aggregate_without_sorting(stored):
    for text in (comparison.lc_class_sql(), coverage.coverage_sql()):
        assert "SortAggregate" not in plan(stored.sql(text))


def test_runs_are_never_spread_over_years(stored):
    """Years are filled in above the running sum; below it runs are only added up."""
    text = plan(serials.serials_active(stored))
    spread = text.index("Generate explode")
    assert "Window [" in text[spread:] and text.count("Generate") == 1
    assert "Expand" in text[text.index("Window [") :]


def test_top_lists_limit_before_the_shuffle(stored):
    from shelftally.operators import archives, links

    for df in (links.link_hosts(stored), archives.archive_genre(stored)):
        assert plan(df).count("WindowGroupLimit") == 2


def test_org_and_tag_reach_the_scan(stored):
    from shelftally.operators import records

    text = plan(records.org_field_count(stored, "856", "u", org="nation_3"))
    assert "PartitionFilters: [isnotnull(org" in text and "= nation_3" in text
    assert "EqualTo(tag,856)" in text


def test_control_numbers_are_read_once(stored):
    channels.patterns(stored).count()
    for report in (channels.channel_coverage, channels.channel_namespace):
        assert "035" not in plan(report(stored))
