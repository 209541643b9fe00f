"""
Who made each record's description, from the agency codes of field 040.

The lake is read once into a roll-up: counts per holder, year the record entered the
catalogue, original agency, its owner, origin bucket and modification depth. One grouping-sets
pass over it makes the few thousand cells that all views are cut from: sums, windows by org
and one explode.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.functions import exprs as x
from shelftally.functions import vocab
from shelftally.params import Params
from shelftally.plans.matrix import matrix_of_cells, without_totals
from shelftally.plans.suppress import fold_columns, require_reconciled
from shelftally.sources.code_map import OWNER_SQL, owners, require_mapped
from shelftally.sources.lake import DEAL, Lake

# --- the roll-up -------------------------------------------------------------


FIRST_AGENCY = f"named_struct('field_seq', {x.sequence('field_seq')}, 'subfield_seq', {x.sequence('subfield_seq')}, 'agency', agency)"
FIRST_STAMP = f"named_struct('field_seq', {x.sequence('field_seq')}, 'stamp', {x.piece(x.ENTERED)})"

DEALT_SQL = f"""\
slice AS (
  SELECT org, record_id, 1L AS copies, false AS is_040,
         CAST(NULL AS STRUCT<field_seq: INT, subfield_seq: INT, agency: STRING>) AS origin,
         CAST(NULL AS STRING) AS modifier,
         CAST(NULL AS STRUCT<field_seq: INT, stamp: STRING>) AS entered
  FROM record_meta WHERE record_id IS NOT NULL
  UNION ALL
  SELECT org, record_id, 0L, true,
         CASE WHEN code = 'a' AND agency <> '' THEN {FIRST_AGENCY} END,
         CASE WHEN code = 'd' AND agency <> '' THEN agency END,
         NULL
  FROM (SELECT org, record_id, code, field_seq, subfield_seq, {x.agency_code()} AS agency
        FROM records WHERE tag = '040' AND record_id IS NOT NULL)
  UNION ALL
  SELECT org, record_id, 0L, false, NULL, NULL, {FIRST_STAMP}
  FROM records WHERE tag = '008' AND record_id IS NOT NULL
),
per_record AS (
  SELECT org, sum(copies) AS copies, bool_or(is_040) AS has_040,
         min(origin).agency AS source_code, size(collect_set(modifier)) AS agencies,
         min(entered).stamp AS stamp
  FROM (SELECT {DEAL}* FROM (SELECT xxhash64(org, record_id) AS h, * FROM slice))
  GROUP BY h, org, record_id
)"""

IN_PLACE_SQL = f"""\
facts AS (
  SELECT org, record_id, bool_or(tag = '040') AS has_040,
         min(CASE WHEN tag = '040' AND code = 'a' AND agency <> '' THEN {FIRST_AGENCY} END).agency AS source_code,
         size(collect_set(CASE WHEN tag = '040' AND code = 'd' AND agency <> '' THEN agency END)) AS agencies,
         min(CASE WHEN tag = '008' THEN {FIRST_STAMP} END).stamp AS stamp
  FROM (SELECT org, record_id, tag, code, field_seq, subfield_seq, value, {x.agency_code()} AS agency
        FROM records WHERE tag IN ('040', '008') AND record_id IS NOT NULL)
  GROUP BY org, record_id
),
per_record AS (
  SELECT org, copies, coalesce(has_040, false) AS has_040, source_code, coalesce(agencies, 0L) AS agencies, stamp
  FROM (SELECT org, record_id, count(*) AS copies FROM record_meta WHERE record_id IS NOT NULL GROUP BY org, record_id)
    LEFT JOIN facts USING (org, record_id)
)"""


def counts_sql(p: Params, by_record: bool = False) -> str:
    """
    Per-record facts in one exchange of the field slices and no join: ``record_meta`` and
    the two slices meet in a single grouping by record. ``copies`` weighs a record by its
    rows in ``record_meta`` and drops field rows of records that have none there. The
    original agency is the first non-blank $a, the entry date the first 008.

    String aggregates are sorted, so rows are spread and led by a hash of the record: one
    sort serves every aggregate, and eight bytes order rows without comparing the long
    common prefixes of record ids. The few agencies of a record are collected and not counted
    as DISTINCT, which would pass every row through four aggregates where two do. Rows without a record id, of which there may be many,
    belong to no record and are counted apart.

    In a lake bucketed ``by_record`` the slices are grouped and joined where they lie.
    """
    return f"""\
WITH {IN_PLACE_SQL if by_record else DEALT_SQL}
SELECT org, {x.entered_year('stamp', p.now_year)} AS entered_year, source_code,
       {x.modification_depth('has_040', 'agencies')} AS mod_depth,
       sum(copies) AS n
FROM (
  SELECT * FROM per_record WHERE copies > 0
  UNION ALL
  SELECT org, count(*), false, NULL, 0L, NULL FROM record_meta WHERE record_id IS NULL GROUP BY org
)
GROUP BY ALL"""


SOURCE_SQL = f"""\
SELECT org, entered_year, source_code, owner AS source_org,
       {x.origin_bucket('source_code', 'owner', 'org')} AS bucket,
       mod_depth, n
FROM cataloging_counts LEFT JOIN code_owner ON source_code = code_owner.code"""


def steps(p: Params) -> list[tuple[str, str]]:
    """The views every query below needs first, as statements in order."""
    return [
        (
            "Per-record facts of field 040, rolled up once",
            f"CREATE OR REPLACE TEMP VIEW cataloging_counts AS\n{counts_sql(p)}",
        ),
        (
            "Owner of each original agency",
            "CREATE OR REPLACE TEMP VIEW code_owner AS\n"
            + OWNER_SQL.replace(
                "FROM codes",
                "FROM (SELECT DISTINCT source_code AS code FROM cataloging_counts"
                " WHERE source_code IS NOT NULL)",
            ),
        ),
        (
            "Origin of each group of records",
            f"CREATE OR REPLACE TEMP VIEW cataloging_source AS\n{SOURCE_SQL}",
        ),
    ]


def cataloging_source(lake: Lake) -> DataFrame:
    """The roll-up itself. The code map is only met after records are counted away."""
    counts = lake.table("cataloging_counts", lambda: lake.sql(counts_sql(lake.params, lake.by_record)))

    def build() -> DataFrame:
        codes = counts.select(F.col("source_code").alias("code")).where("code IS NOT NULL").distinct()
        return lake.sql(SOURCE_SQL, cataloging_counts=counts, code_owner=owners(lake, codes))

    return lake.keep("cataloging_source", build)


# --- the cells ---------------------------------------------------------------

CELLS_SQL = """\
SELECT CASE WHEN grouping(bucket) = 0 THEN 'origin' WHEN grouping(source_code) = 0 THEN 'agency'
            ELSE 'depth' END AS facet,
       org, entered_year, bucket, source_code, source_org, mod_depth, sum(n) AS n
FROM cataloging_source
GROUP BY GROUPING SETS ((org, entered_year, bucket), (org, source_code, source_org), (org, mod_depth))
UNION ALL
SELECT 'held', org, NULL, NULL, NULL, NULL, NULL, count(*) FROM record_meta GROUP BY org
UNION ALL
SELECT DISTINCT 'member', org, NULL, NULL, NULL, NULL, NULL, 0L FROM code_map"""


def cells(lake: Lake) -> DataFrame:
    """
    What the views read: counts by ``facet``, the records held by each org, counted apart
    from the roll-up so that the timeline can be proved against them, and the members. They
    are dealt by org, as the views group them.
    """

    def build() -> DataFrame:
        require_mapped(lake)
        return lake.sql(CELLS_SQL, cataloging_source=cataloging_source(lake)).repartition("org")

    held = lake.keep("provenance_cells", build)
    lake.fact("provenance_axes", lambda: _axes(held, lake.params))
    return held


def _axes(held: DataFrame, p: Params) -> dict[str, list[str]]:
    """
    The categories that two matrices publish, worked out once beside the cells: every org,
    and the union of each org's own top agencies by total. Both are bounded by the orgs.
    """
    listed = held.where(F.col("facet").isin("member", "held")).select("org").distinct()
    named = held.where("facet = 'agency' AND source_code IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("org").orderBy(F.desc("n"), "source_code"))
    best = named.withColumn("place", place).groupBy("source_code").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    top = best.where(F.col("place") <= p.agencies_per_org).orderBy(F.desc("n"), "source_code")
    return {"members": sorted(r["org"] for r in listed.collect()), "agencies": [r["source_code"] for r in top.collect()]}


def axes(lake: Lake) -> dict[str, list[str]]:
    held = cells(lake)
    return lake.fact("provenance_axes", lambda: _axes(held, lake.params))


def _facet(lake: Lake, name: str) -> DataFrame:
    return cells(lake).where(F.col("facet") == name)


def _by_bucket(rows: DataFrame, by: list[str], total: str) -> tuple[DataFrame, Column]:
    """One row for each group with a column for each bucket, and the array that makes rows of them."""
    sums = [F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(b) for b in vocab.ORIGIN_BUCKETS]
    wide = rows.groupBy(*by).agg(F.sum("n").alias(total), *sums)
    return wide, F.array(
        *[
            F.struct(F.lit(b).alias("bucket"), F.lit(i).alias("bucket_rank"), F.col(b).alias("n"))
            for i, b in enumerate(vocab.ORIGIN_BUCKETS, 1)
        ]
    )


def cat_mix(lake: Lake) -> DataFrame:
    """
    Records of each org by origin bucket, all five buckets in fixed order; small buckets
    are folded into ``other`` so that the shares still sum to one.
    """
    wide, buckets = _by_bucket(_facet(lake, "origin"), ["org"], "records")
    folded = fold_columns(wide, vocab.ORIGIN_BUCKETS, threshold=lake.params.threshold)
    rows = folded.select("org", "records", F.explode(buckets).alias("b")).select("org", "b.*", "records")
    return rows.withColumn("share", F.expr(x.share("n", "records")))


# --- agencies, flow, depth ---------------------------------------------------


def _agencies(lake: Lake) -> DataFrame:
    return _facet(lake, "agency").where("source_code IS NOT NULL")


def agency_totals(lake: Lake) -> DataFrame:
    """Records that name an original agency: the denominator of the agency matrix."""
    return _agencies(lake).groupBy("org").agg(F.sum("n").alias("n"))


def cat_agency(lake: Lake) -> DataFrame:
    """
    Original agencies on one axis: the union of each org's own top codes, so that a
    small org's main agency is not ranked away by a large one's. Shares are of all
    records that name an agency.
    """
    total = F.sum("n").over(Window.partitionBy("org"))
    axis = F.lit(axes(lake)["agencies"])
    named = _agencies(lake).withColumn("total", total).where(F.array_contains(axis, F.col("source_code")))
    return matrix_of_cells(named.select("org", F.col("source_code").alias("category"), "n", "total"), lake.params.threshold, axis=axis)


def cat_flow(lake: Lake) -> DataFrame:
    """
    Holder by credited member, square over every org in the map or in the lake, the
    diagonal included. No totals: the categories exhaust them.
    """
    axis = F.lit(axes(lake)["members"])
    credited = _facet(lake, "agency").where("source_org IS NOT NULL")
    counts = credited.groupBy("org", F.col("source_org").alias("category")).agg(F.sum("n").alias("n"))
    return without_totals(matrix_of_cells(counts, lake.params.threshold, axis=axis))


def flow_off_diagonal(lake: Lake) -> DataFrame:
    """The flow with self-cataloguing blanked, which would dwarf everything else."""
    return cat_flow(lake).withColumn(
        "n", F.when(F.col("org") != F.col("category"), F.col("n"))
    )


def cat_mod_depth(lake: Lake) -> DataFrame:
    """Distinct modifying agencies per record; "no field" and "none named" kept apart."""
    counts = _facet(lake, "depth").select("org", F.col("mod_depth").alias("category"), "n")
    axis = F.array(*map(F.lit, vocab.DEPTH_BUCKETS))
    return matrix_of_cells(counts, lake.params.threshold, axis=axis)


# --- by year -----------------------------------------------------------------


def _years(lake: Lake) -> tuple[DataFrame, Column]:
    """
    Buckets per org and year, ``year`` NULL where records cannot be placed: without a
    usable entry date, outside the years published, or in a year under the threshold.
    """
    p = lake.params
    known = F.when(F.col("entered_year").between(p.entered_from, p.now_year), F.col("entered_year"))
    in_year = F.sum("n").over(Window.partitionBy("org", "known"))
    rows = _facet(lake, "origin").withColumn("known", known).withColumn("in_year", in_year)
    placed = rows.withColumn("year", F.when(F.col("in_year") >= p.threshold, F.col("known")))
    return _by_bucket(placed, ["org", "year"], "total")


def _timeline(lake: Lake) -> DataFrame:
    wide, buckets = _years(lake)
    folded = fold_columns(wide.where("year IS NOT NULL"), vocab.ORIGIN_BUCKETS, threshold=lake.params.threshold)
    return folded.select("org", "year", "total", F.explode(buckets).alias("b")).select("org", "year", "b.*", "total")


def cat_timeline(lake: Lake, *, check: bool = True) -> DataFrame:
    """
    The mix by the year a record entered the catalogue, five buckets per published year.
    A year under the threshold joins the unplaced records rather than being listed as
    dropped; with ``check`` what is published is first proved to cover every record.
    """
    if check and "timeline" not in lake.checked:
        require_reconciled(
            timeline_cover(lake),
            _facet(lake, "held").select("org", "n"),
            by="org",
            what="the published years and the unplaced records do not make up the records held",
        )
        lake.checked.add("timeline")
    return _timeline(lake)


def cat_unplaced(lake: Lake) -> DataFrame:
    """Per org, the records no published year accounts for."""
    wide, _ = _years(lake)
    outside = F.sum(F.when(F.col("year").isNull(), F.col("total")))
    return wide.groupBy("org").agg(F.coalesce(outside, F.lit(0)).alias("unplaced"))


def timeline_cover(lake: Lake) -> DataFrame:
    """
    Records per org that the published rows account for: the buckets as shown, which must
    also add up to the total shown for their year, and the unplaced remainder.
    """
    years = _timeline(lake).groupBy("org", "year").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    agreed = years.select("org", F.when(F.col("n") == F.col("total"), F.col("n")).otherwise(F.lit(0)).alias("n"))
    return agreed.unionByName(cat_unplaced(lake).withColumnRenamed("unplaced", "n")).groupBy("org").agg(F.sum("n").alias("n"))


def mix_by_year(lake: Lake) -> DataFrame:
    """The timeline up to the last full year, one row per year and bucket."""
    return (
        cat_timeline(lake)
        .where(F.col("year") < lake.params.now_year)
        .select("org", "year", "bucket", "bucket_rank", "n")
    )


def original_share(lake: Lake) -> DataFrame:
    """Records credited to their own holder, as count and share of each full year."""
    return (
        cat_timeline(lake)
        .where((F.col("bucket") == "self") & (F.col("year") < lake.params.now_year))
        .select(
            "org", "year", "total", F.col("n").alias("original"),
            F.expr("n / CAST(total AS DOUBLE)").alias("share"),
        )
    )


def unplaced_summary(lake: Lake) -> DataFrame:
    """Unplaced records of the whole lake and their share of all records."""
    wide, _ = _years(lake)
    outside = F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("total"))), F.lit(0))
    sums = wide.agg(outside.alias("unplaced"), F.coalesce(F.sum("total"), F.lit(0)).alias("records"))
    return sums.withColumn("share", F.expr("try_divide(unplaced, CAST(records AS DOUBLE))"))


# --- the map as used ---------------------------------------------------------


def cat_self_codes(lake: Lake) -> DataFrame:
    """Records of an org credited to each of its own codes."""
    return _facet(lake, "agency").where("source_org = org").select("org", F.col("source_code").alias("code"), "n")


def code_map_listed(lake: Lake) -> DataFrame:
    """Every row of the map with the records it accounts for at its own org."""
    used = cat_self_codes(lake)
    return (
        lake.code_map.join(used, ["org", "code"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            "org",
            "code",
            F.when(F.col("is_marc"), "marc").otherwise("oclc").alias("kind"),
            "registry_name",
            F.expr(x.published("n", lake.params.threshold)).alias("records"),
        )
    )


VIA_FAMILY_SQL = """\
SELECT used.org, used.code, max_by(base.code, length(base.code)) AS parent, any_value(used.n) AS n
FROM self_codes AS used
LEFT ANTI JOIN code_map ON used.org = code_map.org AND used.code = code_map.code
JOIN code_map AS base
  ON base.org = used.org AND base.is_marc AND startswith(used.code, concat(base.code, '-'))
GROUP BY used.org, used.code"""


def code_map_via_family(lake: Lake) -> DataFrame:
    """Codes that count only because a listed MARC code covers them, under the longest one."""
    rows = lake.sql(VIA_FAMILY_SQL, self_codes=cat_self_codes(lake))
    return rows.select(
        "org", "code", "parent", F.expr(x.published("n", lake.params.threshold)).alias("records")
    )
