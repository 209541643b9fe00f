"""Serials: when they ran, when they began, how titles succeed one another, their status."""

from pyspark.sql import DataFrame

from shelftally.functions import exprs as x
from shelftally.functions import vocab
from shelftally.operators.fixed_fields import fixed_fields
from shelftally.params import Params
from shelftally.plans.matrix import fixed_axis, matrix, org_totals
from shelftally.sources.lake import Lake

# The subset every measure here starts from, kept because there are several.
SUBSET_SQL = f"""\
SELECT DISTINCT org, record_id
FROM records
WHERE tag = 'LDR' AND {x.piece(x.BIB_LEVEL)} = 's'"""


def of_serials(where: str) -> str:
    """Rows of ``records`` that meet a condition and belong to a serial."""
    return f"records LEFT SEMI JOIN serial_records USING (org, record_id)\n  WHERE {where}"


def serial_records(lake: Lake) -> DataFrame:
    return lake.table("serial_records", lambda: lake.sql(SUBSET_SQL))


def steps() -> list[tuple[str, str]]:
    return [("All serials", f"CREATE OR REPLACE TEMP VIEW serial_records AS\n{SUBSET_SQL}")]


def active_sql(p: Params) -> str:
    """
    Serials published in each year, by a sweep over the years: a run adds its titles in its
    first year and takes them back after its last, and a running sum is what is published.
    Runs are only added up by their ends; years are filled in between the few that see a change.
    """
    return f"""\
WITH run AS (
  SELECT org, {x.year('date1')} AS first_year,
         CASE WHEN date2 = '9999' OR kind = 'c' THEN {p.now_year}
              WHEN kind = 'd' THEN {x.year('date2')} END AS last_year,
         n
  FROM fixed_fields
  WHERE is_serial AND chars >= 15
),
change AS (
  SELECT org, coalesce(first_year, last_year + 1) AS year, sum(if(is_last, -n, n)) AS n
  FROM (
    SELECT org, first_year, last_year, grouping(first_year) = 1 AS is_last, sum(n) AS n
    FROM run
    WHERE first_year BETWEEN {p.serial_active_from} AND {p.now_year}
      AND last_year BETWEEN first_year AND {p.now_year}
    GROUP BY GROUPING SETS ((org, first_year), (org, last_year))
  )
  GROUP BY ALL
)
SELECT org, explode(sequence(year, until - 1)) AS year, records
FROM (
  SELECT org, year, sum(n) OVER (PARTITION BY org ORDER BY year) AS records,
         lead(year) OVER (PARTITION BY org ORDER BY year) AS until
  FROM change
)
WHERE records > 0"""


def start_decade_sql(p: Params) -> str:
    low, high = p.serial_start_years
    return f"""\
SELECT org, {x.decade('began')} AS decade, sum(n) AS records
FROM (SELECT org, {x.year('date1')} AS began, n FROM fixed_fields WHERE is_serial AND chars >= 11)
WHERE began BETWEEN {low} AND {high}
GROUP BY ALL"""


TOTAL_SQL = "SELECT org, count(*) AS n FROM serial_records GROUP BY org"


def link_sql() -> str:
    tags = x.in_list(vocab.SUCCESSION_LINKS.values())
    arms = " ".join(f"WHEN '{t}' THEN '{c}'" for c, t in vocab.SUCCESSION_LINKS.items())
    return f"""\
SELECT org, CASE tag {arms} END AS category, count(DISTINCT record_id) AS n
FROM {of_serials(f"tag IN {tags}")}
GROUP BY ALL"""


def type_sql() -> str:
    return f"""\
SELECT org, ind2 AS category, count(DISTINCT record_id) AS n
FROM {of_serials(f"tag = '785' AND ind2 IN {x.in_list(vocab.SUCCESSION_TYPES)}")}
GROUP BY ALL"""


def status_sql() -> str:
    return f"""\
SELECT org, kind AS category, sum(n) AS n
FROM fixed_fields
WHERE is_serial AND kind IN {x.in_list(vocab.SERIAL_STATUSES)}
GROUP BY ALL"""


def _of_fields(lake: Lake, text: str) -> DataFrame:
    return lake.sql(text, fixed_fields=fixed_fields(lake))


def _statuses(lake: Lake) -> DataFrame:
    return lake.counts("serial_status", status_sql(), fixed_fields=fixed_fields(lake))


def _counts(lake: Lake, name: str, text: str) -> DataFrame:
    return lake.counts(name, text, serial_records=serial_records(lake))


def serials_active(lake: Lake) -> DataFrame:
    return _of_fields(lake, active_sql(lake.params))


def serials_start_decade(lake: Lake) -> DataFrame:
    return _of_fields(lake, start_decade_sql(lake.params))


def serials_total(lake: Lake) -> DataFrame:
    """Serial records per org: the denominator of both succession measures."""
    return _counts(lake, "serials_total", TOTAL_SQL)


def _of_all_serials(lake: Lake, counts: DataFrame, axis: DataFrame | None) -> DataFrame:
    totals = serials_total(lake).withColumnRenamed("n", "total")
    return matrix(counts, lake.params.threshold, axis=axis, totals=totals)


def succession_link(lake: Lake) -> DataFrame:
    """Serials that name an earlier or a later title, as shares of all serials."""
    axis = fixed_axis(lake.spark, vocab.SUCCESSION_LINKS)
    return _of_all_serials(lake, _counts(lake, "succession_link", link_sql()), axis)


def succession_type(lake: Lake) -> DataFrame:
    """Serials by kind of later title, present kinds only, most common first."""
    return _of_all_serials(lake, _counts(lake, "succession_type", type_sql()), None)


def serial_status(lake: Lake) -> DataFrame:
    """Still published, ceased or unknown, ranked by consortium total."""
    return matrix(_statuses(lake), lake.params.threshold, top_k=lake.params.compare_top_k)


def serial_status_ordered(lake: Lake) -> DataFrame:
    """The same cells in the fixed order still published, ceased, unknown."""
    counts = _statuses(lake)
    axis = fixed_axis(lake.spark, vocab.SERIAL_STATUSES).join(
        counts.select("category").distinct(), "category", "left_semi"
    )
    return matrix(counts, lake.params.threshold, axis=axis, totals=org_totals(counts))
