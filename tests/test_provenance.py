"""Provenance and channels: rules stated one by one, over small catalogues made for each."""

import pytest
from conftest import as_dict, as_set, cells

from shelftally.functions import vocab
from shelftally.operators import channels, coverage, probe, provenance
from shelftally.plans import suppress
from shelftally.sources.code_map import UnmappedOrgError

# alder is a MARC family, birch has a family and a symbol, cedar symbols only.
TREES = [
    ("alder", "AlD", True),
    ("birch", "BiR", True),
    ("birch", "BQ7", False),
    ("cedar", "CDR", False),
    ("cedar", "CD2", False),
]


def field(*subfields):
    """One 040 field from ``a=...`` and ``d=...`` pairs, in order."""
    return [("040", code, value) for code, value in subfields]


def entered(stamp):
    return ("008", stamp + "|" * 34)


def mix(lake, org):
    return {r["bucket"]: r["n"] for r in provenance.cat_mix(lake).collect() if r["org"] == org}


@pytest.mark.parametrize(
    "code, bucket",
    [
        ("DLC", "lc"), (" dlc. ", "lc"), ("DLC-X9", "lc"), ("DLCX", "other"),
        ("AlD", "self"), ("*ald*", "self"), ("ALD-MAP-2", "self"), ("AlDx", "other"),
        ("BiR-1", "pod"), ("bq7", "pod"), ("BQ7-1", "other"), ("CD2,", "pod"), ("CD", "other"), ("QQQ", "other"),
    ],
)
def test_bucket_of_one_code(shelf, code, bucket):
    shelf.add("alder", 1, field(("a", code)))
    got = mix(shelf.lake(TREES, threshold=1), "alder")
    assert got == {b: int(b == bucket) for b in vocab.ORIGIN_BUCKETS}


def test_first_non_blank_agency_in_field_order(shelf):
    shelf.add("alder", 1, field(("a", " .;"), ("a", "BiR")), field(("a", "DLC")))
    shelf.add("alder", 2, field(("d", "DLC")), field(("a", "CDR")))
    shelf.add("alder", 3, field(("b", "eng")))
    # a field without a number comes after all that have one
    shelf.rows += [("alder", "alder:4", "040", None, " ", " ", "a", 0, "DLC"), ("alder", "alder:4", "040", 9, " ", " ", "a", 0, "AlD")]
    shelf.meta.append(("alder", "alder:4", "four"))
    got = as_set(provenance.cataloging_source(shelf.lake(TREES)), "source_code", "bucket", "mod_depth")
    assert got == {("BIR", "pod", "0"), ("CDR", "pod", "1"), (None, "none", "0"), ("ALD", "self", "0")}


@pytest.mark.parametrize("n, depth", [(0, "0"), (1, "1"), (2, "2"), (3, "3-4"), (4, "3-4"), (5, "5-9"), (9, "5-9"), (10, "10+"), (25, "10+")])
def test_depth_counts_distinct_modifiers(shelf, n, depth):
    shelf.add("birch", 1, field(("a", "DLC"), *[("d", f"m{i}") for i in range(n)], *[("d", f"*M{i}.") for i in range(n)], ("d", " ")))
    shelf.add("birch", 2)
    got = cells(provenance.cat_mod_depth(shelf.lake(TREES, threshold=1)), "birch")
    assert got == {d: int(d in (depth, "no_040")) for d in vocab.DEPTH_BUCKETS}


def test_rows_outside_record_meta_do_not_count(shelf):
    shelf.add("cedar", 1, field(("a", "CDR")), ("650", "a", "Bark"))
    shelf.add("cedar", "unlisted", field(("a", "DLC")), count=False)
    for i in range(7):
        shelf.rows.append(("cedar", None, "040", i, " ", " ", "a", 0, "DLC"))
        shelf.rows.append(("cedar", None, "650", i, " ", " ", "a", 0, "Moss"))
    shelf.meta.append(("cedar", None, "no id"))
    lake = shelf.lake(TREES, threshold=1)
    assert mix(lake, "cedar") == {"lc": 0, "self": 1, "pod": 0, "other": 0, "none": 1}
    assert as_dict(coverage.coverage(lake), "field", "n")["subjects"] == 1


@pytest.fixture
def grove(shelf):
    """30 records of alder and 4 of birch over few agencies."""
    for i in range(30):
        code = "DLC" if i < 14 else "AlD-M" if i < 25 else "BiR" if i < 28 else "ZZ9"
        shelf.add("alder", i, field(("a", code)))
    for i, code in enumerate(["BQ7", "BiR", "AlD", "AlD"]):
        shelf.add("birch", i, field(("a", code)))
    return shelf


def test_mix_moves_small_buckets(grove):
    rows = [r for r in provenance.cat_mix(grove.lake(TREES, threshold=5)).orderBy("bucket_rank").collect()]
    alder = [(r["bucket"], r["n"], r["share"]) for r in rows if r["org"] == "alder"]
    assert alder == [("lc", 14, 0.4667), ("self", 11, 0.3667), ("pod", 0, 0.0), ("other", 5, 0.1667), ("none", 0, 0.0)]
    assert mix(grove.lake(TREES, threshold=5), "birch") == {"lc": 0, "self": 0, "pod": 0, "other": 4, "none": 0}
    leaks = suppress.small_cells(provenance.cat_mix(grove.lake(TREES, threshold=5)), threshold=5, label="bucket", other="other")
    assert leaks.isEmpty()


def test_flow_is_square_and_without_totals(grove):
    lake = grove.lake(TREES, threshold=1)
    flow = provenance.cat_flow(lake)
    assert cells(flow, "alder") == {"alder": 11, "birch": 3, "cedar": 0} and cells(flow, "birch") == {"alder": 2, "birch": 2, "cedar": 0}
    assert not {"total", "share"} & set(flow.columns)
    assert as_dict(flow, "category", "cat_rank") == {"alder": 1, "birch": 2, "cedar": 3}
    off = provenance.flow_off_diagonal(lake)
    assert cells(off, "alder") == {"alder": None, "birch": 3, "cedar": 0}
    assert cells(provenance.cat_flow(grove.lake(TREES, threshold=3)), "birch") == {"alder": None, "birch": None, "cedar": 0}


def test_agency_axis_joins_each_orgs_top_codes(grove):
    lake = grove.lake(TREES, threshold=1, agencies_per_org=1)
    agency = provenance.cat_agency(lake)
    assert as_dict(agency, "category", "cat_rank") == {"DLC": 1, "ALD": 2}
    assert cells(agency, "alder") == {"DLC": 14, "ALD": 0} and cells(agency, "birch") == {"DLC": 0, "ALD": 2}
    assert as_dict(agency, "org", "total") == {"alder": 30, "birch": 4}
    assert as_dict(provenance.agency_totals(lake), "org", "n") == {"alder": 30, "birch": 4}


def test_map_as_used(grove):
    lake = grove.lake(TREES, threshold=3)
    listed = {r["code"]: (r["kind"], r["records"]) for r in provenance.code_map_listed(lake).collect()}
    assert listed == {"ALD": ("marc", 0), "BIR": ("marc", None), "BQ7": ("oclc", None), "CDR": ("oclc", 0), "CD2": ("oclc", 0)}
    via = as_set(provenance.code_map_via_family(lake), "org", "code", "parent", "records")
    assert via == {("alder", "ALD-M", "ALD", 11)}
    assert as_set(provenance.cat_self_codes(lake), "org", "code", "n") == {("alder", "ALD-M", 11), ("birch", "BQ7", 1), ("birch", "BIR", 1)}


def test_nearest_listed_head_is_the_parent(shelf):
    shelf.add("alder", 1, field(("a", "ald-m-x-y")))
    lake = shelf.lake([*TREES, ("alder", "AlD-M", True), ("alder", "AlD-M-X", True)], threshold=1)
    assert as_dict(provenance.code_map_via_family(lake), "code", "parent") == {"ALD-M-X-Y": "ALD-M-X"}


# --- by year -----------------------------------------------------------------


@pytest.mark.parametrize(
    "stamp, year",
    [("700630", 1970), ("260101", 2026), ("270101", None), ("660101", 1966), ("650101", None), ("000101", 2000), ("000000", None), ("9x0101", None), ("7006", None)],
)
def test_year_of_entry(shelf, stamp, year):
    shelf.add("cedar", 1, field(("a", "CDR")), ("008", stamp))
    lake = shelf.lake(TREES, threshold=1, now_year=2026)
    assert as_set(provenance.cat_timeline(lake).where("n > 0"), "year", "bucket", "total") == ({(year, "self", 1)} if year else set())
    assert as_dict(provenance.cat_unplaced(lake), "org", "unplaced") == {"cedar": int(year is None)}


@pytest.fixture
def decades(shelf):
    """Records of cedar: 9 in 1988 (7 own, 2 lc), 6 in 1991 (all pod), 2 in 2003, 1 undated."""
    plan = [("880101", "CDR", 7), ("881231", "DLC", 2), ("910515", "AlD", 6), ("030303", "CDR", 2), ("      ", "DLC", 1)]
    for stamp, code, n in plan:
        for i in range(n):
            # only the first 008 of a record dates it
            shelf.add("cedar", f"{stamp}-{i}", field(("a", code)), entered(stamp), entered("990101"))
    return shelf


def years(lake):
    out = {}
    for r in provenance.cat_timeline(lake).collect():
        out.setdefault(r["year"], {"total": r["total"]})[r["bucket"]] = r["n"]
    return out


def test_timeline_in_full(decades):
    lake = decades.lake(TREES, threshold=1)
    assert years(lake) == {
        1988: {"total": 9, "lc": 2, "self": 7, "pod": 0, "other": 0, "none": 0},
        1991: {"total": 6, "lc": 0, "self": 0, "pod": 6, "other": 0, "none": 0},
        2003: {"total": 2, "lc": 0, "self": 2, "pod": 0, "other": 0, "none": 0},
    }
    assert as_dict(provenance.original_share(lake), "year", "share") == {1988: 7 / 9, 1991: 0.0, 2003: 1.0}
    assert as_dict(provenance.timeline_cover(lake), "org", "n") == {"cedar": 18}


def test_timeline_withholds_small_years_and_folds_small_buckets(decades):
    lake = decades.lake(TREES, threshold=5)
    assert years(lake) == {
        1988: {"total": 9, "lc": 0, "self": 7, "pod": 0, "other": 2, "none": 0},
        1991: {"total": 6, "lc": 0, "self": 0, "pod": 6, "other": 0, "none": 0},
    }
    assert provenance.unplaced_summary(lake).first().asDict() == {"unplaced": 3, "records": 18, "share": 3 / 18}
    assert as_dict(provenance.timeline_cover(lake), "org", "n") == {"cedar": 18}
    current = decades.lake(TREES, threshold=1, now_year=2003)
    assert {r["year"] for r in provenance.mix_by_year(current).collect()} == {1988, 1991}


def test_timeline_refuses_a_fold_that_loses_records(decades, monkeypatch):
    whole = suppress.fold_columns
    monkeypatch.setattr(provenance, "fold_columns", lambda wide, *a, **k: whole(wide, *a, **k).withColumn("self", provenance.F.lit(0)))
    with pytest.raises(suppress.ReconciliationError, match="cedar"):
        provenance.cat_timeline(decades.lake(TREES, threshold=1))


def test_reconciliation_names_every_difference(spark):
    parts = spark.createDataFrame([(f"o{i:02d}", i) for i in range(40)], "org string, n long")
    whole = spark.createDataFrame([(f"o{i:02d}", i + i % 2) for i in range(40)], "org string, n long")
    with pytest.raises(suppress.ReconciliationError) as refused:
        suppress.require_reconciled(parts, whole, by="org", what="parts")
    assert all((f"o{i:02d} " in str(refused.value)) == bool(i % 2) for i in range(40))


def test_views_take_few_jobs(grove):
    spark = grove.spark
    lake = grove.lake(TREES, threshold=1)
    provenance.cells(lake).count()
    provenance.cat_timeline(lake)  # the guard runs once
    tracker, group = spark.sparkContext.statusTracker(), "views"
    spark.sparkContext.setJobGroup(group, group)
    for view in (provenance.cat_mix, provenance.cat_agency, provenance.cat_flow, provenance.cat_mod_depth, provenance.cat_timeline):
        view(lake).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 12


# --- the probe, guards, channels ---------------------------------------------


def test_probe_by_share_and_by_place(shelf):
    for i in range(9):
        for j in range(9 - i):
            shelf.add("birch", f"{i}-{j}", field(("a", f" q{i}. ")))
    shelf.add("cedar", 1, field(("a", "Q8")))
    rows = {(r["org"], r["code"]): r for r in probe.code_probe(shelf.lake(TREES, probe_min_share=0.15, probe_top=1)).collect()}
    assert set(rows) == {("birch", "Q0"), ("birch", "Q1"), ("birch", "Q2"), ("cedar", "Q8")}
    first = rows["birch", "Q0"]
    assert (first["n"], first["pct_of_org"], first["pct_at_this_org"]) == (9, 20.0, 100.0)
    assert rows["cedar", "Q8"]["pct_at_this_org"] == 50.0


def test_every_unmapped_org_is_named(shelf):
    strangers = [f"tree{i:03d}" for i in range(120)]
    for org in ("alder", *strangers):
        shelf.meta.append((org, f"{org}:1", "t"))
    for report in (provenance.cat_mix, channels.channel_coverage):
        with pytest.raises(UnmappedOrgError) as refused:
            report(shelf.lake(TREES))
        head = str(refused.value).split("\n")[0]
        assert all(org in head for org in strangers) and "alder" not in head


@pytest.fixture
def numbered(shelf):
    def add(org, rid, *numbers):
        shelf.add(org, rid, *[("035", "a", n) for n in numbers], ("035", "z", "(ZZZ)9"))

    add("alder", 1, "(OCoLC)ocm1", "(OCoLC-M)2")
    add("alder", 2, "(AlD-M)3", "(BiR)4")
    add("alder", 3, "\t(CKB)5", "(EXLCZ)6")
    add("alder", 4, "(SIRSI)7", "8")
    add("alder", 5, "( CStRLIN )9", "x (AlD)10")
    add("birch", 1, "()11", "(PUVoyagerBIBID)12")
    add("birch", 2)
    return shelf


def test_channels(numbered):
    rows = channels.channel_coverage(numbered.lake(TREES, threshold=1)).collect()
    got = {(r["org"], r["channel"]): (r["n"], r["share"]) for r in rows}
    alder = {"oclc": 1, "rlin": 1, "alma_cz": 1, "local_system": 2, "pod_system": 1, "any_system": 5}
    assert {c: got["alder", c] for c in vocab.CHANNELS} == {c: (n, n / 5) for c, n in alder.items()}
    assert got["birch", "local_system"] == (1, 0.5) and got["birch", "any_system"] == (1, 0.5) and got["birch", "oclc"] == (0, 0.0)
    hidden = channels.channel_coverage(numbered.lake(TREES, threshold=3)).collect()
    assert {(r["n"], r["share"]) for r in hidden if r["channel"] in ("oclc", "local_system")} == {(None, None), (0, 0.0)}


def test_namespaces_need_a_share_of_some_org(numbered):
    every = channels.channel_namespace(numbered.lake(TREES, threshold=1))
    assert cells(every, "alder") == {"OCOLC": 1, "OCOLC-M": 1, "ALD-M": 1, "BIR": 1, "CKB": 1, "EXLCZ": 1, "SIRSI": 1, "CSTRLIN": 1, "PUVOYAGERBIBID": 0}
    assert as_dict(every, "org", "total") == {"alder": 5, "birch": 2}
    half = channels.channel_namespace(numbered.lake(TREES, threshold=1, namespace_min_share=0.4))
    assert set(cells(half, "birch")) == {"PUVOYAGERBIBID"}
