"""
How records reached each org, from the namespaces of field 035 control numbers.

The field is read once into namespace patterns: for each org, the set of namespaces that a
record carries, and how many records carry just that set. Owners, channels and namespace
counts follow from the patterns, of which there are few.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelftally.functions import exprs as x
from shelftally.functions import vocab
from shelftally.params import Params
from shelftally.plans.matrix import matrix
from shelftally.sources.code_map import OWNER_SQL, owners, require_mapped
from shelftally.sources.lake import Lake

PATTERNS_SQL = f"""\
SELECT org, prefixes, count(*) AS n
FROM (
  SELECT org, record_id, array_sort(collect_set(prefix)) AS prefixes
  FROM (
    SELECT org, record_id, {x.namespace()} AS prefix
    FROM records
    WHERE tag = '035' AND code = 'a' AND record_id IS NOT NULL
  )
  WHERE prefix <> ''
  GROUP BY org, record_id
)
GROUP BY org, prefixes"""

PREFIX_SQL = "SELECT DISTINCT code FROM (SELECT explode(prefixes) AS code FROM namespace_patterns)"


def coverage_sql() -> str:
    """Flags per pattern, then sums per org; channels overlap and are no partition."""
    tests = x.channel_tests("prefix", "owner", "org")
    bits = "\n            | ".join(f"if({test}, {1 << i}, 0)" for i, test in enumerate(tests.values()))
    counts = ",\n       ".join(f"sum(if(bits & {1 << i} > 0, n, 0)) AS {name}" for i, name in enumerate(tests))
    return f"""\
SELECT org, sum(held) AS records,
       {counts}
FROM (
  SELECT org, 1L AS held, 0 AS bits, 0L AS n FROM record_meta
  UNION ALL
  SELECT org, 0L, bit_or(bits), any_value(n)
  FROM (
    SELECT org, prefixes, n,
           (  {bits}) AS bits
    FROM (SELECT org, prefixes, n, explode(prefixes) AS prefix FROM namespace_patterns)
      LEFT JOIN prefix_owner ON prefix = prefix_owner.code
  )
  GROUP BY org, prefixes
)
GROUP BY org
HAVING records > 0"""


def steps() -> list[tuple[str, str]]:
    return [
        (
            "Records by the set of namespaces they carry",
            f"CREATE OR REPLACE TEMP VIEW namespace_patterns AS\n{PATTERNS_SQL}",
        ),
        ("Kept, since all that follows reads it", "CACHE LAZY TABLE namespace_patterns"),
        (
            "Owner of each namespace",
            "CREATE OR REPLACE TEMP VIEW prefix_owner AS\n"
            + OWNER_SQL.replace("FROM codes", f"FROM ({PREFIX_SQL})"),
        ),
        (
            "Records per namespace",
            f"CREATE OR REPLACE TEMP VIEW namespaces AS\n{USED_SQL}",
        ),
    ]


def patterns(lake: Lake) -> DataFrame:
    return lake.table("namespace_patterns", lambda: lake.sql(PATTERNS_SQL))


def prefixes(lake: Lake) -> DataFrame:
    """Every namespace in use, once."""
    return lake.sql(PREFIX_SQL, namespace_patterns=patterns(lake))


def prefix_owners(lake: Lake) -> DataFrame:
    """
    Owners of the distinct namespaces some org claims. Computed and measured first: the
    namespace column is very skewed, and the true size of this side decides whether its
    join with the record rows is a broadcast.
    """
    return lake.measured("prefix_owner", lambda: owners(lake, prefixes(lake)))


def _mapped(lake: Lake) -> None:
    if "mapped" not in lake.checked:
        require_mapped(lake)
        lake.checked.add("mapped")


def channel_counts(lake: Lake) -> DataFrame:
    """Per org, records carrying each channel's number, unsuppressed and wide."""
    _mapped(lake)
    return lake.sql(coverage_sql(), namespace_patterns=patterns(lake), prefix_owner=prefix_owners(lake))


def channel_coverage(lake: Lake) -> DataFrame:
    """One row per org and channel; count and share both NULL when too small to publish."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), F.lit(i).alias("channel_rank"), F.col(c).alias("n"))
            for i, c in enumerate(vocab.CHANNELS, 1)
        ]
    )
    shown = f"n = 0 OR n >= {lake.params.threshold}"
    return (
        channel_counts(lake)
        .select("org", "records", F.explode(cells).alias("cell"))
        .select("org", "records", "cell.*")
        .select(
            "org",
            "channel",
            "channel_rank",
            F.expr(f"CASE WHEN {shown} THEN n END").alias("n"),
            "records",
            F.expr(f"CASE WHEN {shown} THEN {x.share('n', 'records')} END").alias("share"),
        )
    )


USED_SQL = """\
SELECT org, prefix AS category, sum(n) AS n
FROM (SELECT org, n, explode(prefixes) AS prefix FROM namespace_patterns)
GROUP BY org, prefix"""


def namespace_sql(p: Params) -> str:
    """
    Counts of every org for the namespaces that reach a share of some org's records and
    are among that org's own most common. Reads the counts of all namespaces twice.
    """
    return f"""\
SELECT org, category, n
FROM namespaces LEFT SEMI JOIN (
  SELECT category FROM (
    SELECT category, row_number() OVER (PARTITION BY org ORDER BY n DESC, category) AS place
    FROM namespaces JOIN (SELECT org, count(*) AS records FROM record_meta GROUP BY org) USING (org)
    WHERE n >= records * {p.namespace_min_share:f}D
  )
  WHERE place <= {p.namespaces_per_org}
) USING (category)"""


TOTAL_SQL = "SELECT org, count(*) AS n FROM record_meta GROUP BY org"


def namespace_totals(lake: Lake) -> DataFrame:
    """Every record, with a control number or not: the namespace denominator."""
    return lake.sql(TOTAL_SQL)


def channel_namespace(lake: Lake) -> DataFrame:
    """Raw namespaces as shares of all records of each org."""
    _mapped(lake)
    used = lake.counts("namespaces", USED_SQL, namespace_patterns=patterns(lake))
    counts = lake.counts("channel_namespace", namespace_sql(lake.params), namespaces=used)
    totals = (
        namespace_totals(lake)
        .withColumnRenamed("n", "total")
        .join(counts.select("org").distinct(), "org", "left_semi")
    )
    return matrix(counts, lake.params.threshold, totals=totals)
