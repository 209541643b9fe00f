"""
The coded values of field 008, read once for every report that counts them.

Leaders and 008 fields of a record meet in one grouping, which tells serials and archival
records from the rest; after that only counts per combination of values are kept.
"""

from pyspark.sql import DataFrame

from shelftally.functions import exprs as x
from shelftally.functions import vocab
from shelftally.sources.lake import Lake

# The longest field that any report asks for; beyond it lengths need not be told apart.
LONGEST = 38

VALUES = (
    f"named_struct('chars', least(length(value), {LONGEST}), 'kind', {x.piece(x.DATE_TYPE)},"
    f" 'date1', {x.piece(x.DATE_1)}, 'date2', {x.piece(x.DATE_2)},"
    f" 'place', {x.piece(x.PLACE)}, 'language', {x.piece(x.LANGUAGE)})"
)
SERIAL = f"{x.piece(x.BIB_LEVEL)} = 's'"
ARCHIVAL = (
    f"length(value) >= 8 AND ({x.piece(x.RECORD_TYPE)} IN {x.in_list(vocab.ARCHIVE_TYPES)}"
    f" OR {x.piece(x.BIB_LEVEL)} IN {x.in_list(vocab.ARCHIVE_LEVELS)})"
)

# Leaders that are neither serial nor archival change nothing and are left out of the grouping.
# Rows without a record id have no leader; they are counted where they are read.
FIXED_SQL = f"""\
WITH slice AS (
  SELECT org, record_id, tag = 'LDR' AND {SERIAL} AS is_serial,
         if(tag = 'LDR' AND {ARCHIVAL}, 1L, 0L) AS leaders,
         CASE WHEN tag = '008' THEN {VALUES} END AS field
  FROM records
  WHERE tag IN ('LDR', '008') AND record_id IS NOT NULL AND value IS NOT NULL
    AND (tag = '008' OR {SERIAL} OR {ARCHIVAL})
)
SELECT org, is_serial, archival, field.*, count(*) AS n
FROM (
  SELECT org, is_serial, archival, explode(fields) AS field
  FROM (
    SELECT org, record_id, bool_or(is_serial) AS is_serial, sum(leaders) AS archival, collect_list(field) AS fields
    FROM slice
    GROUP BY org, record_id
  )
)
GROUP BY ALL
UNION ALL
SELECT org, false, 0L, field.*, count(*)
FROM (SELECT org, {VALUES} AS field FROM records WHERE tag = '008' AND record_id IS NULL AND value IS NOT NULL)
GROUP BY ALL"""


def fixed_fields(lake: Lake) -> DataFrame:
    return lake.table("fixed_fields", lambda: lake.sql(FIXED_SQL))


def steps() -> list[tuple[str, str]]:
    return [
        ("Coded values of field 008, counted once", f"CREATE OR REPLACE TEMP VIEW fixed_fields AS\n{FIXED_SQL}"),
        ("Kept, since what follows reads it more than once", "CACHE LAZY TABLE fixed_fields"),
    ]
