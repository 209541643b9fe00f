"""Which agency codes each org uses, for curating the code map."""

from pyspark.sql import DataFrame

from shelftally.functions import exprs as x
from shelftally.params import Params
from shelftally.sources.lake import Lake


def probe_sql(p: Params) -> str:
    """
    Codes that reach a share of the org's records, plus the org's most used ones. The two
    selections are separate branches so that the second can limit by rank before it
    shuffles, whatever the number of distinct codes.
    """
    return f"""\
WITH used AS (
  SELECT org, {x.agency_code()} AS code, count(*) AS n
  FROM records
  WHERE tag = '040' AND code = 'a'
  GROUP BY ALL
),
named AS (SELECT org, code, n FROM used WHERE code <> ''),
held AS (SELECT org, count(*) AS records FROM record_meta GROUP BY org),
everywhere AS (SELECT code, sum(n) AS n_all_orgs FROM named GROUP BY code),
picked AS (
  SELECT org, code, n FROM named JOIN held USING (org)
  WHERE n >= {p.probe_min_share:f}D * records
  UNION
  SELECT org, code, n FROM (
    SELECT org, code, n, row_number() OVER (PARTITION BY org ORDER BY n DESC, code) AS place
    FROM named
  )
  WHERE place <= {p.probe_top}
)
SELECT org, code, n,
       round(100D * n / records, 3) AS pct_of_org,
       round(100D * n / n_all_orgs, 1) AS pct_at_this_org
FROM picked JOIN held USING (org) JOIN everywhere USING (code)"""


def code_probe(lake: Lake) -> DataFrame:
    return lake.sql(probe_sql(lake.params))
