import pytest
from pyspark.sql import functions as F

from shelftally.functions import exprs as x
from shelftally.functions import labels


def one(spark, expression, **columns):
    """Evaluate an expression over a stored row, so that nothing is folded away early."""
    names = ", ".join(f"{k} string" for k in columns)
    df = spark.createDataFrame([tuple(columns.values())], names)
    return df.select(F.expr(expression).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("DLC", "DLC"),
        (" *dlc-R*. ", "DLC-R"),
        ("*YNH*", "YNH"),
        ("\t NjP,;:\r\n", "NJP"),
        (" . ", ""),
        ("PU-L", "PU-L"),
        (None, None),
    ],
)
def test_agency_code(spark, raw, want):
    assert one(spark, x.agency_code("v"), v=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("(OCoLC)123", "OCOLC"),
        ("  \t(OCoLC-M) 9", "OCOLC-M"),
        ("( SIRSI )a1", "SIRSI"),
        ("12345", ""),
        ("x(OCoLC)1", ""),
        ("()1", ""),
        ("(" + "A" * 25 + ")1", ""),
        (None, None),
    ],
)
def test_namespace(spark, raw, want):
    assert one(spark, x.namespace("v"), v=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("1999", 1999), ("18uu", None), ("19 9", None), ("", None), (None, None), ("0000", 0)],
)
def test_year_never_fails_on_bad_dates(spark, raw, want):
    assert one(spark, x.year("v"), v=raw) == want


@pytest.mark.parametrize(
    "stamp, want",
    [
        ("850101", 1985),
        ("991231", 1999),
        ("050615", 2005),
        ("260110", 2026),
        ("270110", 1927),
        ("000000", None),
        ("000101", 2000),
        ("xxxxxx", None),
        ("8501", None),
        (None, None),
    ],
)
def test_entered_year(spark, stamp, want):
    assert one(spark, x.entered_year("v", 2026), v=stamp) == want


@pytest.mark.parametrize(
    "host, want",
    [
        ("findingaids.lib.edu", "finding_aid"),
        ("archives.jstor.org", "finding_aid"),
        ("oac.cdlib.org", "aggregator"),
        ("www.oac.cdlib.org", "aggregator"),
        ("xoac.cdlib.org", "other"),
        ("hdl.handle.net", "resolver"),
        ("dx.doi.org", "resolver"),
        ("doi.org.example", "other"),
        ("www.jstor.org", "vendor"),
        ("digital.library.edu", "repository"),
        ("idn.duke.edu", "repository"),
        ("idnxduke.edu", "other"),
        ("", "other"),
    ],
)
def test_destination(spark, host, want):
    assert one(spark, x.destination("v"), v=host) == want


def test_link_and_host(spark):
    assert one(spark, x.link_host("v"), v="HTTPS://Jstor.ORG/a/b") == "jstor.org"
    assert one(spark, x.link_host("v"), v="http:/broken") == ""
    assert one(spark, x.is_link("v"), v="http://a") is True
    assert one(spark, x.is_link("v"), v="HTTP://a") is False


def test_genre_term(spark):
    assert one(spark, x.genre_term("v"), v=" Photographs. . ") == "photographs"
    assert one(spark, x.genre_term("v"), v="U.S. maps.") == "u.s. maps"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("QA76", True),
        ("  pn 1", True),
        (" DA10", True),
        ("Q180", True),
        ("QS 4", False),
        ("qw100", False),
        ("823.91", False),
        ("I1", False),
        ("W 1", False),
        ("", False),
    ],
)
def test_lc_shape(spark, raw, want):
    assert one(spark, x.is_lc_shaped("v"), v=raw) is want


def test_country_roll_up(spark):
    want = {"CAU": "XXU", "ONC": "XXC", "UIK": "XXK", "UUU": "XX", "FR": "FR", "GWU": "GWU", "NBC": "NBC"}
    for code, country in want.items():
        assert one(spark, x.country("v"), v=code) == country


def test_position_number_orders_as_its_parts(spark):
    rows = [(p, f, s) for p in (0, 6) for f in (None, -7, 0, 2**24, 2**31 - 1) for s in (None, -1, 0, 2**31 - 1)]
    df = spark.createDataFrame(rows, "p int, field_seq int, subfield_seq int")
    got = df.orderBy(F.expr(x.place_in_record(top="p"))).collect()
    last = 2**31  # rows without a position come after all others
    key = lambda r: (r[0], last if r[1] is None else r[1], last if r[2] is None else r[2])
    assert [key(r) for r in got] == sorted(key(r) for r in rows)


def test_published_and_share(spark):
    df = spark.createDataFrame([(0, 100), (9, 100), (10, 100), (1, 32), (5, 0)], "n long, t long")
    got = df.select(F.expr(x.published("n", 10)).alias("n"), F.expr(x.share("n", "t")).alias("s")).collect()
    assert [r["n"] for r in got] == [0, None, 10, None, None]
    assert [r["s"] for r in got] == [0.0, 0.09, 0.1, 0.0313, 0.0]


def test_labels(spark):
    df = spark.createDataFrame([("ENG",), ("qqq",)], "category string")
    got = {r["category"]: r["label"] for r in labels.label(df, "category", labels.LANGUAGE).collect()}
    assert got == {"ENG": "English", "qqq": "qqq"}
    df = spark.createDataFrame([("CST",), ("STF",), ("VEN1",)], "category string")
    got = {r["category"]: r["label"] for r in labels.label_agency(df).collect()}
    assert got == {"CST": "Stanford (CST)", "STF": "Stanford (STF)", "VEN1": "VEN1"}
    df = spark.createDataFrame([("OCOLC",), ("MIAAPQ",), ("Z",)], "category string")
    got = {r["category"]: r["label"] for r in labels.label_namespace(df).collect()}
    assert got == {"OCOLC": "OCLC / WorldCat (OCOLC)", "MIAAPQ": "ProQuest (MIAAPQ)", "Z": "Z"}
    df = spark.createDataFrame([("mit",), ("yale",), ("",)], "org string")
    got = [r[0] for r in df.select(labels.org_label()).collect()]
    assert got == ["MIT", "Yale", ""]
