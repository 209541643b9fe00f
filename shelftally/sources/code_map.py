"""
The curated map of agency codes to orgs: loading, checking, resolving.

Comparison ignores case; hyphens are significant. A MARC organisation code also covers
its hyphenated children (``CtY`` covers ``CtY-BR``, never ``CtYX``); OCLC symbols are
opaque and match exactly.
"""

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelftally import schema
from shelftally.functions import exprs
from shelftally.sources.binding import bind
from shelftally.sources.lake import Lake


class CodeMapError(ValueError):
    """The code map is malformed or would credit the wrong org."""


class UnmappedOrgError(ValueError):
    """The lake holds orgs the code map does not know."""


REQUIRED = ("marc_code", "oclc_code")

# --- loading -----------------------------------------------------------------


def read_code_map(
    spark: SparkSession, path: str, *, org_column: str = "institution", check: bool = True
) -> DataFrame:
    """
    Read the map from a CSV with a header: the org, ``marc_code``, ``oclc_code`` and
    optionally ``registry_name``, exactly one of the two code columns filled per row.
    The file is hand-curated, a few hundred rows; ``seq`` keeps its order. White space of
    any kind around a value is dropped. Messages name every finding. A code that is MARC
    for one org and OCLC for another is legal and gives a warning.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    missing = [c for c in (org_column, *REQUIRED) if c not in raw.columns]
    if missing:
        raise CodeMapError(f"no column {', '.join(missing)} in {path}; it has {', '.join(raw.columns)}")

    def text(name: str):
        column = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        return F.btrim(F.coalesce(column, F.lit("")), F.lit(exprs.WHITE))

    marc, oclc = text("marc_code"), text("oclc_code")
    # one file read by one task, so the generated id counts lines in file order
    rows = raw.coalesce(1).select(
        text(org_column).alias("org"),
        marc.alias("marc"),
        oclc.alias("oclc"),
        text("registry_name").alias("registry_name"),
        F.monotonically_increasing_id().alias("seq"),
    )
    code_map = rows.select(
        "org",
        F.upper(F.when(marc_given(), F.col("marc")).otherwise(F.col("oclc"))).alias("code"),
        marc_given().alias("is_marc"),
        "registry_name",
        "seq",
    )
    if check:
        bad = rows.where((F.col("org") == "") | (marc_given() == (F.col("oclc") != "")))
        findings = [f"row {r['seq'] + 1} {_fault(r)}" for r in bad.orderBy("seq").collect()]
        if findings:
            raise CodeMapError(f"{path}: " + "; ".join(findings))
        if rows.isEmpty():
            raise CodeMapError(f"{path} holds a header and nothing else")
        require_valid(code_map)
        shared = ambiguous_codes(spark, code_map).orderBy("code").collect()
        if shared:
            listed = ", ".join(f"{r['code']} ({', '.join(r['orgs'])})" for r in shared)
            warnings.warn(f"{path}: codes used in both namespaces, credited to the org listed first: {listed}", stacklevel=2)
    return code_map


def _fault(row) -> str:
    if not row["org"]:
        return "names no org"
    if row["marc"]:
        return f"gives both a MARC code ({row['marc']}) and an OCLC symbol ({row['oclc']}); split it into two rows"
    return f"gives no code for {row['org']}"


def marc_given():
    return F.col("marc") != ""


def code_map_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A map from ``(org, code, is_marc)`` or ``(org, code, is_marc, registry_name)`` tuples."""
    full = [
        (r[0], r[1].upper(), r[2], r[3] if len(r) > 3 else "", i) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema.CODE_MAP)


# --- checking ----------------------------------------------------------------

# Every hyphen-bounded head of a code, the code itself included.
HEADS = (
    "transform(sequence(1, size(split(code, '-'))),"
    " i -> array_join(slice(split(code, '-'), 1, i), '-'))"
)

VIOLATIONS_SQL = f"""\
SELECT 'contested' AS problem, code, is_marc, array_sort(collect_set(org)) AS orgs
FROM code_map
GROUP BY code, is_marc
HAVING count(DISTINCT org) > 1
UNION ALL
SELECT DISTINCT 'family' AS problem, child.code, child.is_marc, array(base.org, child.org) AS orgs
FROM (SELECT org, code, is_marc, explode({HEADS}) AS head FROM code_map) AS child
JOIN (SELECT org, code FROM code_map WHERE is_marc) AS base ON child.head = base.code
WHERE child.code <> base.code AND child.org <> base.org"""


def violations(spark: SparkSession, code_map: DataFrame) -> DataFrame:
    """
    Codes the map would credit wrongly: claimed by two orgs within one namespace, or
    inside another org's MARC family. Empty for a sound map.
    """
    return bind(spark, VIOLATIONS_SQL, code_map=code_map)


def require_valid(code_map: DataFrame) -> None:
    parts = []
    for r in violations(code_map.sparkSession, code_map).orderBy("problem", "code", "orgs").collect():
        if r["problem"] == "contested":
            kind = "MARC code" if r["is_marc"] else "OCLC symbol"
            parts.append(f"{kind} {r['code']} is claimed by {' and '.join(r['orgs'])}")
        else:
            base, child = r["orgs"]
            parts.append(f"{r['code']} of {child} lies in the MARC family of {base}")
    if parts:
        raise CodeMapError("records would be credited to the wrong org: " + "; ".join(parts))


def ambiguous_codes(spark: SparkSession, code_map: DataFrame) -> DataFrame:
    """
    Codes that are MARC for one org and OCLC for another. Legal, because the namespaces
    differ, and resolved to the org whose first row comes first; worth a warning.
    """
    return bind(
        spark,
        "SELECT code, array_sort(collect_set(org)) AS orgs FROM code_map"
        " GROUP BY code HAVING count(DISTINCT org) > 1",
        code_map=code_map,
    )


# --- resolving ---------------------------------------------------------------

# A code's owner, by equality on its heads instead of a prefix comparison. Where several
# rows match, the org listed first in the map wins. ``codes`` holds distinct codes.
OWNER_SQL = f"""\
SELECT used.code, min_by(claim.org, claim.org_seq) AS owner
FROM (SELECT code, explode({HEADS}) AS head FROM codes) AS used
JOIN (SELECT code, is_marc, org, min(seq) OVER (PARTITION BY org) AS org_seq FROM code_map) AS claim
  ON claim.code = used.head AND (claim.is_marc OR used.head = used.code)
GROUP BY used.code"""


def owners(lake: Lake, codes: DataFrame) -> DataFrame:
    """``(code, owner)`` for those of the distinct ``codes`` that some org claims."""
    return lake.sql(OWNER_SQL, codes=codes)


def unmapped_orgs(lake: Lake) -> DataFrame:
    """Orgs in the lake that own no code in the map."""
    return lake.roster.join(lake.code_map.select("org"), "org", "left_anti").select("org")


def require_mapped(lake: Lake) -> None:
    """
    Refuse to run provenance over an org the map does not know: it would read as
    cataloguing nothing of its own and sharing nothing, which looks like a result.
    """
    from shelftally.operators.probe import probe_sql

    if lake.code_map is None:
        raise UnmappedOrgError("the lake has no code map")
    missing = [r["org"] for r in unmapped_orgs(lake).orderBy("org").collect()]
    if missing:
        raise UnmappedOrgError(
            f"the code map lists no code of {', '.join(missing)}. This query shows the codes"
            " that each org uses and how many of their records lie there:\n\n" + probe_sql(lake.params)
        )
