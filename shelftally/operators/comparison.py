"""Coded distributions compared across orgs: language, place, format, subject class."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelftally.functions import exprs as x
from shelftally.operators.fixed_fields import fixed_fields
from shelftally.operators.serials import serial_records
from shelftally.params import Params
from shelftally.plans.matrix import matrix
from shelftally.plans.suppress import fold_small
from shelftally.sources.lake import Lake

def coded_sql(raw: str, category: str) -> str:
    """
    Records by a code. Raw codes are counted first, so that trimming and rolling up run
    once per distinct code and not once per record.
    """
    return f"""\
SELECT org, {category} AS category, sum(n) AS n
FROM ({raw})
WHERE {x.stripped('raw')} <> ''
GROUP BY ALL"""


CODE = f"upper({x.stripped('raw')})"
LANGUAGE_SQL = coded_sql("SELECT org, language AS raw, sum(n) AS n FROM fixed_fields WHERE chars >= 38 GROUP BY ALL", CODE)
COUNTRY_SQL = coded_sql("SELECT org, place AS raw, sum(n) AS n FROM fixed_fields WHERE chars >= 18 GROUP BY ALL", x.country(CODE))
RECORD_TYPE_SQL = coded_sql(
    f"SELECT org, {x.piece(x.RECORD_TYPE)} AS raw, count(*) AS n\n"
    "      FROM records WHERE tag = 'LDR' AND length(value) >= 7 GROUP BY ALL",
    "raw",
)


def lc_class_sql(serials_only: bool = False) -> str:
    """
    One class letter per record, from its first well-formed call number by location
    priority, then by position in the record.
    """
    only = " LEFT SEMI JOIN serial_records USING (org, record_id)" if serials_only else ""
    return f"""\
SELECT org, chr(CAST(first % 256 AS INT)) AS category, count(*) AS n
FROM (
  SELECT org, record_id, min({x.place_in_record(top='priority', payload='ascii(class)')}) AS first
  FROM (
    SELECT org, record_id, field_seq, subfield_seq, {x.lc_class()} AS class,
           {x.call_number_rank()} AS priority
    FROM records{only}
    WHERE tag IN {x.CALL_NUMBER_TAGS} AND {x.is_lc_shaped()}
  )
  WHERE priority IS NOT NULL
  GROUP BY org, record_id
)
GROUP BY ALL"""


def language_counts(lake: Lake) -> DataFrame:
    return lake.counts("language", LANGUAGE_SQL, fixed_fields=fixed_fields(lake))


def country_counts(lake: Lake) -> DataFrame:
    return lake.counts("country", COUNTRY_SQL, fixed_fields=fixed_fields(lake))


def lang_matrix(lake: Lake) -> DataFrame:
    return _top(lake, language_counts(lake))


def country_matrix(lake: Lake) -> DataFrame:
    return _top(lake, country_counts(lake))


def record_type_matrix(lake: Lake) -> DataFrame:
    return _top(lake, lake.counts("record_type", RECORD_TYPE_SQL))


def lc_class(lake: Lake) -> DataFrame:
    """Every class, so that an org's shares sum to one."""
    return matrix(lake.counts("lc_class", lc_class_sql()), lake.params.threshold)


def lc_class_serial(lake: Lake) -> DataFrame:
    text = lc_class_sql(serials_only=True)
    counts = lake.counts("lc_class_serial", text, serial_records=serial_records(lake))
    return matrix(counts, lake.params.threshold)


def _top(lake: Lake, counts: DataFrame) -> DataFrame:
    return matrix(counts, lake.params.threshold, top_k=lake.params.compare_top_k)


def decade_sql(p: Params) -> str:
    low, high = p.publication_years
    return f"""\
SELECT org, {x.decade('published')} AS decade, sum(n) AS records
FROM (SELECT org, {x.year('date1')} AS published, n FROM fixed_fields)
WHERE published BETWEEN {low} AND {high}
GROUP BY ALL"""


def publication_decade(lake: Lake) -> DataFrame:
    """
    Records by decade of publication; decades under the threshold fold into one row per
    org with no decade and ``is_other`` set.
    """
    folded = fold_small(
        lake.sql(decade_sql(lake.params), fixed_fields=fixed_fields(lake)),
        threshold=lake.params.threshold,
        by=["org"],
        label="decade",
        count="records",
    )
    return folded.select(
        "org",
        F.expr("try_cast(decade AS INT)").alias("decade"),
        (F.col("decade") == "Other").alias("is_other"),
        "records",
    )


def numeric_decades(lake: Lake) -> DataFrame:
    """The decades alone, without the folded remainder."""
    return publication_decade(lake).where("NOT is_other").drop("is_other")
