"""Serials, archives, links, comparison matrices, coverage and decades, rule by rule."""

import pytest
from conftest import BOOK, SERIAL, as_dict, as_set, cells, f008

from shelftally.operators import archives, comparison, coverage, links, serials
from shelftally.plans import derive

LETTERS = "00000ntc a2200000 a 4500"
MAPS = "00000nfm a2200000 a 4500"
KIT = "00000nom a2200000 a 4500"


# --- serials -----------------------------------------------------------------


@pytest.mark.parametrize(
    "kind, date1, date2, years",
    [
        ("d", "1961", "1963", {1961, 1962, 1963}),
        ("d", "1961", "1961", {1961}),
        ("d", "1963", "1961", set()),
        ("d", "1961", "196u", set()),
        ("d", "1961", "9999", set(range(1961, 1971))),
        ("c", "1968", "uuuu", {1968, 1969, 1970}),
        ("u", "1969", "9999", {1969, 1970}),
        ("u", "1969", "1970", set()),
        ("c", "196u", "9999", set()),
        ("c", "1971", "9999", set()),
        ("d", "1499", "1501", set()),
    ],
)
def test_years_of_one_serial(shelf, kind, date1, date2, years):
    shelf.add("oak", 1, ("008", f008(kind=kind, date1=date1, date2=date2)), leader=SERIAL)
    shelf.add("oak", 2, ("008", f008(kind="d", date1="1961", date2="1962")), leader=BOOK)
    shelf.add("oak", 3, ("008", f008(kind="d", date1="1961", date2="1962")[:14]), leader=SERIAL)
    active = serials.serials_active(shelf.lake(now_year=1970))
    assert as_dict(active, "year", "records") == dict.fromkeys(years, 1)


def test_each_date_field_of_a_serial_counts(shelf):
    for rid in (1, 2):
        shelf.add("oak", rid, *[("008", f008(kind="d", date1=d, date2="1952")) for d in ("1951", "1952", "1948")], leader=SERIAL)
    shelf.add("elm", 1, leader=SERIAL)
    lake = shelf.lake()
    assert as_dict(serials.serials_active(lake), "year", "records") == {1948: 2, 1949: 2, 1950: 2, 1951: 4, 1952: 6}
    assert as_dict(serials.serials_start_decade(lake), "decade", "records") == {1940: 2, 1950: 4}
    assert as_dict(serials.serials_total(lake), "org", "n") == {"oak": 2, "elm": 1}
    assert as_dict(derive.serial_vintage(lake), "decade", "share") == {1940: 2 / 6, 1950: 4 / 6}


def test_succession_counts_serials_not_fields(shelf):
    shelf.add("oak", 1, *[("780", "t", "Before", "1", i) for i in "0012"], leader=SERIAL)
    shelf.add("oak", 2, ("780", "t", "Before", "0", "0"), ("785", "t", "After", "0", "4"), ("785", "x", "After", "0", "4"), leader=SERIAL)
    shelf.add("oak", 3, ("785", "t", "After", "0", "8"), ("785", "t", "After", "0", "4"), ("785", "t", "?", "0", "9"), ("785", "t", "?", "0", " "), leader=SERIAL)
    shelf.add("oak", 4, ("785", "t", "After", "0", "0"), leader=BOOK)
    shelf.add("oak", 5, leader=SERIAL)
    lake = shelf.lake(threshold=1)
    link = serials.succession_link(lake)
    assert cells(link, "oak") == {"pred": 2, "succ": 2} and as_dict(link, "category", "share") == {"pred": 0.5, "succ": 0.5}
    kinds = serials.succession_type(lake)
    assert cells(kinds, "oak") == {"4": 2, "8": 1} and as_dict(kinds, "category", "cat_rank") == {"4": 1, "8": 2}
    assert {r["total"] for r in kinds.collect()} == {4}


def test_status_ranked_and_in_order(shelf):
    for i, kind in enumerate("uucdddps|"):
        shelf.add("elm", i, ("008", f008(kind=kind)), leader=SERIAL)
    lake = shelf.lake(threshold=1)
    assert as_dict(serials.serial_status(lake), "category", "cat_rank") == {"d": 1, "u": 2, "c": 3}
    assert as_dict(serials.serial_status_ordered(lake), "category", "cat_rank") == {"c": 1, "d": 2, "u": 3}
    assert {r["total"] for r in serials.serial_status_ordered(lake).collect()} == {6}


# --- archives and links ------------------------------------------------------


@pytest.fixture
def papers(shelf):
    shelf.add("oak", "letters", ("655", "a", " Diaries. "), ("655", "a", "diaries"), ("655", "a", "Ledgers ."), ("655", "b", "Not a"), ("008", f008(date1="1733")), leader=LETTERS)
    shelf.add("oak", "map", ("655", "a", "Diaries,"), ("856", "u", "https://purl.oak.edu/1"), ("856", "u", "ftp://x"), ("008", f008(date1="1739")), leader=MAPS)
    shelf.add("oak", "kit", ("655", "a", "Toys"), ("856", "u", "https://hdl.oak.edu/2"), ("008", f008(date1="1733")), leader=KIT)
    shelf.add("elm", "bundle", ("856", "u", "HTTPS://loud.org"), ("856", "3", "http://elsewhere.org"), ("008", f008(date1="173u")), leader="00000nac a2200000 a 4500")
    return shelf


def test_archival_subset_and_kinds(papers):
    lake = papers.lake(threshold=1)
    assert as_dict(archives.archive_totals(lake), "org", "n") == {"oak": 2, "elm": 1}
    kinds = archives.archive_type(lake)
    assert cells(kinds, "oak") == {"t": 1, "f": 1, "a": 0} and cells(kinds, "elm") == {"t": 0, "f": 0, "a": 1}
    assert as_set(archives.archive_decade(lake), "org", "decade", "n") == {("oak", 1730, 2)}


def test_genre_terms(papers):
    open_ = as_set(archives.archive_genre(papers.lake(threshold=1)), "org", "total", "term", "term_rank", "n")
    assert open_ == {("oak", 2, "diaries", 1, 1), ("oak", 2, "diaries,", 2, 1), ("oak", 2, "ledgers", 3, 1), ("elm", 1, None, None, None)}
    top = archives.archive_genre(papers.lake(threshold=1, genres_per_org=1))
    assert as_dict(top, "org", "term") == {"oak": "diaries", "elm": None}
    assert as_dict(archives.archive_genre(papers.lake(threshold=2)), "org", "term") == {"oak": None, "elm": None}


def test_archive_links(papers):
    lake = papers.lake(threshold=1)
    assert as_set(archives.archive_link(lake), "org", "n", "total") == {("oak", 1, 2), ("elm", 1, 1)}
    assert as_dict(derive.link_share(lake), "org", "place") == {"elm": 1, "oak": 2}
    where = archives.archive_destination(lake)
    assert {c: n for c, n in cells(where, "oak").items() if n} == {"resolver": 1}
    assert set(cells(where, "elm").values()) == {0} and len(cells(where, "elm")) == 6


@pytest.mark.parametrize(
    "host, kind",
    [
        ("findingaids.oak.edu", "finding_aid"), ("archives.gov", "finding_aid"), ("oac.cdlib.org", "aggregator"), ("www.oac.cdlib.org", "aggregator"),
        ("my.oac.cdlib.org", "other"), ("snaccooperative.org", "aggregator"), ("ark.oak.edu", "other"), ("arks.oak.edu", "resolver"),
        ("dx.doi.org", "resolver"), ("doi.org.example", "other"), ("digital.oak.edu", "repository"), ("search.proquest.com", "vendor"),
    ],
)
def test_destination_of_a_host(shelf, host, kind):
    shelf.add("oak", 1, ("856", "u", f"http://{host.upper()}/x"), ("856", "u", f"http://{host}/y"), leader=LETTERS)
    got = cells(archives.archive_destination(shelf.lake(threshold=1)), "oak")
    assert {c for c, n in got.items() if n} == {kind} and got[kind] == 1


def test_a_record_with_two_archival_leaders_counts_twice(shelf):
    shelf.add("elm", 1, ("LDR", MAPS), ("008", f008(date1="1640")), ("856", "u", "http://a.org"), leader=LETTERS)
    lake = shelf.lake(threshold=1)
    assert cells(archives.archive_type(lake), "elm") == {"t": 1, "f": 1}
    assert as_dict(archives.archive_decade(lake), "decade", "n") == {1640: 2}
    assert as_set(archives.archive_link(lake), "n", "total") == {(2, 2)}


def test_hosts_count_links(shelf):
    urls = ["https://b.org/1", "https://B.org/2", "http://a.org", "https://c.org/?http://d.org/", "http:/one-slash", "HTTP://loud.org/", "www.a.org"]
    shelf.add("oak", 1, *[("856", "u", u) for u in urls], ("856", "y", "http://label.org"))
    shelf.add("elm", 1, ("856", "u", "http:none"))
    got = as_set(links.link_hosts(shelf.lake(threshold=1)), "org", "total", "host", "host_rank", "n")
    assert got == {("oak", 5, "b.org", 1, 2), ("oak", 5, "a.org", 2, 1), ("oak", 5, "c.org", 3, 1), ("elm", 1, None, None, None)}
    assert as_dict(links.link_hosts(shelf.lake(threshold=2)).where("host IS NOT NULL"), "host", "n") == {"b.org": 2}


# --- comparison --------------------------------------------------------------


@pytest.fixture
def shelves(shelf):
    for i, (lang, place) in enumerate([("ita", "it "), ("ita", "nyu"), ("ita", "  u"), ("lat", "XXU"), ("lat", "onc"), ("   ", "   "), (" it", "enk")]):
        shelf.add("oak", i, ("008", f008(lang=lang, place=place)))
    shelf.add("elm", 1, ("008", f008(lang="LAT", place="wlk")))
    shelf.add("elm", 2, ("008", f008(lang="ita")[:37]))
    return shelf


def test_language_and_place(shelves):
    lake = shelves.lake(threshold=1)
    lang = comparison.lang_matrix(lake)
    assert cells(lang, "oak") == {"ITA": 3, "LAT": 2, "IT": 1} and cells(lang, "elm") == {"ITA": 0, "LAT": 1, "IT": 0}
    assert as_dict(lang, "category", "cat_rank") == {"ITA": 1, "LAT": 2, "IT": 3}
    assert as_dict(lang, "org", "total") == {"oak": 6, "elm": 1}
    # the three-letter place is read where the language is cut off
    assert cells(comparison.country_matrix(lake), "oak") == {"XXU": 2, "IT": 1, "U": 1, "XXC": 1, "XXK": 1}
    assert cells(comparison.country_matrix(lake), "elm") == {"XXU": 1, "IT": 0, "U": 0, "XXC": 0, "XXK": 1}
    assert cells(comparison.record_type_matrix(lake), "elm") == {"a": 2}


def test_withheld_cells_keep_their_totals(shelves):
    lang = {(r["org"], r["category"]): tuple(r)[3:] for r in comparison.lang_matrix(shelves.lake(threshold=3)).collect()}
    assert lang["oak", "ITA"] == (3, 6, 0.5) and lang["oak", "LAT"] == (None, 6, None) and lang["elm", "ITA"] == (0, 1, 0.0)
    cut = comparison.lang_matrix(shelves.lake(threshold=1, compare_top_k=1))
    assert cells(cut, "oak") == {"ITA": 3} and as_dict(cut, "org", "total") == {"oak": 6, "elm": 1}


@pytest.mark.parametrize(
    "numbers, letter",
    [
        ([("050", "a", " gv1.5")], "G"), ([("050", "a", "QS12")], None), ([("050", "a", "qz9")], None), ([("050", "a", "QR9")], "Q"),
        ([("050", "a", "I5")], None), ([("050", "a", "X5")], None), ([("050", "a", "5 M")], None), ([("050", "b", "H1")], None),
        ([("852", "h", "H1", "1")], None), ([("852", "h", "H1", "0")], "H"), ([("082", "a", "H1")], None),
        ([("949", "a", "A1"), ("099", "a", "B1"), ("900", "f", "C1"), ("950", "a", "D1")], "D"),
        ([("090", "a", "E1"), ("852", "h", "F1", "0"), ("050", "a", "W1")], "E"),
        ([("090", "a", "T1"), ("090", "a", "S1")], "T"),
        ([[("050", "a", "12"), ("050", "a", "R1"), ("050", "a", "N1")]], "R"),
    ],
)
def test_class_of_one_record(shelf, numbers, letter):
    shelf.add("oak", 1, *numbers, leader=SERIAL)
    shelf.add("oak", 2, ("050", "a", "Z1"), leader=BOOK)
    lake = shelf.lake(threshold=1)
    assert cells(comparison.lc_class(lake), "oak") == ({"Z": 1, letter: 1} if letter else {"Z": 1})
    assert cells(comparison.lc_class_serial(lake), "oak") == ({letter: 1} if letter else {})


# --- coverage and decades ----------------------------------------------------


def test_coverage_counts_records_once_per_field(shelf):
    shelf.add("oak", 1, ("020", "a", "1"), ("020", "a", "2"), ("651", "a", "x"), ("600", "a", "y"), ("111", "a", "z"), ("100", "a", "z"))
    shelf.add("oak", 2, ("856", "u", "x"), ("949", "a", "PS1"), ("050", "a", "QV1"), ("660", "a", "x"))
    shelf.add("oak", 3, ("130", "a", "t"), ("30", "a", "short tag"))
    shelf.add("oak", "elsewhere", ("300", "a", "x"), count=False)
    shelf.add("elm", 1)
    got = {(r["org"], r["field"]): (r["n"], r["share"]) for r in coverage.coverage(shelf.lake()).collect()}
    third = round(1 / 3, 4)
    assert {f: v for (o, f), v in got.items() if o == "oak"} == {
        "isbn": (1, third), "subjects": (2, round(2 / 3, 4)), "author": (1, third), "online": (1, third), "phys_desc": (1, third), "lc_classification": (1, third),
    }
    assert {v for (o, _), v in got.items() if o == "elm"} == {(0, 0.0)}
    order = coverage.field_order(shelf.lake()).orderBy("place").collect()
    assert order[0]["field"] == "subjects" and [r["field"] for r in order[1:]] == sorted(r["field"] for r in order[1:])


def test_publication_decades(shelf):
    for i, date in enumerate(["1999", "1990", "1995", "2000", "1449", "1450", "199u", "2026", "2100"]):
        shelf.add("oak", i, ("008", f008(date1=date)))
    open_ = as_set(comparison.publication_decade(shelf.lake(threshold=1)), "decade", "is_other", "records")
    assert (1990, False, 3) in open_ and (2000, False, 1) in open_ and not any(d in (1440, 2100) for d, *_ in open_)
    rest = sum(n for d, _, n in open_ if d != 1990)
    folded = comparison.publication_decade(shelf.lake(threshold=2))
    assert as_set(folded, "decade", "is_other", "records") == {(1990, False, 3), (None, True, rest)}
    assert as_set(comparison.numeric_decades(shelf.lake(threshold=2)), "org", "decade") == {("oak", 1990)}
