"""Archives and manuscripts: material, genre, vintage, and where their links lead."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.functions import exprs as x
from shelftally.functions import vocab
from shelftally.operators.fixed_fields import fixed_fields
from shelftally.params import Params
from shelftally.plans.matrix import fixed_axis, matrix
from shelftally.sources.lake import Lake

# The subset every measure here starts from: a manuscript type of record or a collection
# level. One row per leader, so a record with two leaders counts twice throughout.
SUBSET_SQL = f"""\
SELECT org, record_id, {x.piece(x.RECORD_TYPE)} AS kind
FROM records
WHERE tag = 'LDR' AND length(value) >= 8
  AND ({x.piece(x.RECORD_TYPE)} IN {x.in_list(vocab.ARCHIVE_TYPES)}
       OR {x.piece(x.BIB_LEVEL)} IN {x.in_list(vocab.ARCHIVE_LEVELS)})"""

TOTAL_SQL = "SELECT org, count(*) AS n FROM archival_records GROUP BY org"

TYPE_SQL = "SELECT org, kind AS category, count(*) AS n FROM archival_records GROUP BY ALL"

GENRE_SQL = f"""\
SELECT org, {x.genre_term()} AS category, count(DISTINCT record_id) AS n
FROM records LEFT SEMI JOIN archival_records USING (org, record_id)
WHERE tag = '655' AND code = 'a' AND {x.stripped('value')} <> ''
GROUP BY ALL"""

LINK_SQL = """\
SELECT org, count(*) AS n
FROM archival_records
LEFT SEMI JOIN (SELECT org, record_id FROM records WHERE tag = '856' AND code = 'u')
  USING (org, record_id)
GROUP BY org"""

DESTINATION_SQL = f"""\
SELECT org, {x.destination('host')} AS category, count(DISTINCT record_id) AS n
FROM (
  SELECT org, record_id, {x.link_host()} AS host
  FROM records LEFT SEMI JOIN archival_records USING (org, record_id)
  WHERE tag = '856' AND code = 'u' AND {x.is_link()}
)
GROUP BY ALL"""


def decade_sql(p: Params) -> str:
    low, high = p.archive_years
    return f"""\
SELECT org, {x.decade('began')} AS decade, sum(n) AS n
FROM (
  SELECT org, {x.year('date1')} AS began, n * archival AS n
  FROM fixed_fields
  WHERE archival > 0 AND chars >= 11
)
WHERE began BETWEEN {low} AND {high}
GROUP BY ALL"""


def archival_records(lake: Lake) -> DataFrame:
    return lake.table("archival_records", lambda: lake.sql(SUBSET_SQL))


def steps() -> list[tuple[str, str]]:
    return [
        ("All archival records", f"CREATE OR REPLACE TEMP VIEW archival_records AS\n{SUBSET_SQL}")
    ]


def _sql(lake: Lake, text: str) -> DataFrame:
    return lake.sql(text, archival_records=archival_records(lake))


def _counts(lake: Lake, name: str, text: str) -> DataFrame:
    return lake.counts(name, text, archival_records=archival_records(lake))


def archive_totals(lake: Lake) -> DataFrame:
    return _counts(lake, "archive_totals", TOTAL_SQL)


def _totals(lake: Lake) -> DataFrame:
    return archive_totals(lake).withColumnRenamed("n", "total")


def archive_type(lake: Lake) -> DataFrame:
    """Archival records by type of record."""
    p = lake.params
    return matrix(
        _counts(lake, "archive_type", TYPE_SQL), p.threshold, top_k=p.material_types, totals=_totals(lake)
    )


def archive_genre(lake: Lake) -> DataFrame:
    """
    Each org's own most common genre terms among those that reach the threshold. An
    org without any keeps one row with no term, so every archival total is published.
    """
    order = [F.desc("n"), F.asc("term")]
    top = (
        _sql(lake, GENRE_SQL)
        .withColumnRenamed("category", "term")
        .where(F.col("n") >= lake.params.threshold)
        .withColumn("term_rank", F.row_number().over(Window.partitionBy("org").orderBy(*order)))
        .where(F.col("term_rank") <= lake.params.genres_per_org)
    )
    return _totals(lake).join(top, "org", "left").select("org", "total", "term", "term_rank", "n")


def archive_decade(lake: Lake) -> DataFrame:
    return lake.sql(decade_sql(lake.params), fixed_fields=fixed_fields(lake))


def archive_link(lake: Lake) -> DataFrame:
    """Archival records with an online link, over all archival records, for every org."""
    linked = _sql(lake, LINK_SQL)
    return (
        _totals(lake)
        .join(linked, "org", "left")
        .select("org", F.coalesce("n", F.lit(0)).alias("n"), "total")
    )


def archive_destination(lake: Lake) -> DataFrame:
    """Archival records by kind of link destination; all six kinds, used or not."""
    axis = fixed_axis(lake.spark, vocab.DESTINATION_ORDER)
    return matrix(
        _counts(lake, "archive_destination", DESTINATION_SQL), lake.params.threshold, axis=axis, totals=_totals(lake)
    )
