"""Metadata completeness: how many records carry each field."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.functions import exprs as x
from shelftally.functions import vocab
from shelftally.sources.lake import Lake

FIELDS = (*vocab.COVERAGE_FIELDS, "lc_classification")


def coverage_sql() -> str:
    """
    One bit per field and record first, then one sum per org: no distinct count, and a
    record's rows, which lie together in a lake, collapse before the shuffle. The records
    held, the denominator, join the same sum instead of a join of their own.
    """
    tests = vocab.COVERAGE_FIELDS | {
        "lc_classification": f"({x.call_number_rank()}) IS NOT NULL AND {x.is_lc_shaped()}"
    }
    bits = "\n            | ".join(f"if({test}, {1 << i}, 0)" for i, test in enumerate(tests.values()))
    counts = ",\n       ".join(f"count_if(bits & {1 << i} > 0) AS {name}" for i, name in enumerate(tests))
    tags = x.in_list(sorted({*vocab.COVERAGE_TAGS, *(t for t, _, _ in vocab.CALL_NUMBER_LOCATIONS)}))
    return f"""\
SELECT org, sum(held) AS records,
       {counts}
FROM (
  SELECT org, 1L AS held, 0 AS bits FROM record_meta
  UNION ALL
  SELECT org, 0L, bit_or(bits)
  FROM (
    SELECT org, record_id,
           (  {bits}) AS bits
    FROM records
    WHERE (startswith(tag, '6') OR tag IN {tags}) AND record_id IS NOT NULL
  )
  GROUP BY org, record_id
)
GROUP BY org
HAVING records > 0"""


def field_counts(lake: Lake) -> DataFrame:
    return lake.sql(coverage_sql())


def coverage(lake: Lake) -> DataFrame:
    """One row per org and field: records carrying it and their share of all records."""
    cells = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in FIELDS]
    )
    return (
        field_counts(lake)
        .select("org", "records", F.explode(cells).alias("cell"))
        .select("org", "records", "cell.*")
        .select("org", "field", "n", "records", F.expr(x.share("n", "records")).alias("share"))
    )


def field_order(lake: Lake) -> DataFrame:
    """Fields by mean share across orgs, most covered first."""
    means = coverage(lake).groupBy("field").agg(F.round(F.avg("share"), 6).alias("mean_share"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_share"), F.asc("field")))
    return means.select("field", "mean_share", place.alias("place"))
