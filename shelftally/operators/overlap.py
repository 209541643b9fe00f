"""
Holdings overlap, all from one roll-up of titles to holding patterns.

A title's pattern has one bit per org. Grouping titles by pattern is the only pass over
``record_meta``; it combines map-side, so a title key shared by a large part of all
records costs no more than any other. Every measure then reads the small pattern table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelftally.sources.lake import Lake

# A BIGINT word holds this many orgs; larger consortia use several words.
WORD = 63


def masks(orgs: int) -> list[str]:
    return [f"mask_{w}" for w in range(max(1, (orgs + WORD - 1) // WORD))]


def pattern_sql(orgs: int) -> str:
    """Holding pattern -> number of titles and records, the NULL title key kept apart."""
    bits = ",\n         ".join(
        f"coalesce(bit_or(CASE WHEN position div {WORD} = {w}"
        f" THEN shiftleft(1L, CAST(position % {WORD} AS INT)) END), 0L) AS {mask}"
        for w, mask in enumerate(masks(orgs))
    )
    key = ", ".join(masks(orgs))
    return f"""\
SELECT {key}, keyed, count(*) AS titles, sum(records) AS records
FROM (
  SELECT title_key IS NOT NULL AS keyed, count(*) AS records,
         {bits}
  FROM record_meta LEFT JOIN roster USING (org)
  GROUP BY title_key
)
GROUP BY {key}, keyed"""


def holders(orgs: int) -> str:
    """Number of orgs in a pattern."""
    return "CAST(" + " + ".join(f"bit_count({m})" for m in masks(orgs)) + " AS BIGINT)"


def holds(position: int) -> str:
    """Whether the org at a position is in a pattern."""
    return f"getbit(mask_{position // WORD}, {position % WORD}) = 1"


def positions(orgs: int) -> str:
    """Positions of the orgs in a pattern."""
    words = ", ".join(masks(orgs))
    return (
        f"filter(sequence(0, {max(orgs - 1, 0)}),"
        f" p -> getbit(element_at(array({words}), CAST(p div {WORD} AS INT) + 1), p % {WORD}) = 1)"
    )


TOTALS_SQL = """\
SELECT coalesce(sum(records), 0) AS records,
       coalesce(sum(titles) FILTER (WHERE keyed), 0) AS titles,
       (SELECT count(*) FROM roster) AS institutions
FROM patterns"""


def per_org_sql(orgs: int, measure: str, where: str) -> str:
    """Titles of some patterns summed per org that holds them."""
    return f"""\
SELECT org, coalesce(n, 0) AS {measure}
FROM roster LEFT JOIN (
  SELECT position, sum(titles) AS n
  FROM (SELECT explode({positions(orgs)}) AS position, titles FROM patterns WHERE {where})
  GROUP BY position
) USING (position)"""


def org_titles_sql(orgs: int) -> str:
    return per_org_sql(orgs, "titles", "keyed")


def uniqueness_sql(orgs: int) -> str:
    alone = per_org_sql(orgs, "unique_titles", f"{holders(orgs)} = 1")
    return f"SELECT org, unique_titles FROM (\n{alone}\n)\nWHERE unique_titles > 0"


def histogram_sql(orgs: int) -> str:
    return f"""\
SELECT {holders(orgs)} AS institutions, sum(titles) AS titles
FROM patterns
GROUP BY ALL"""


def pairwise_sql(orgs: int) -> str:
    """
    Each pattern is read once per org that holds it and feeds one sum per partner, so
    no row is ever emitted per pair of holders.
    """
    orgs = max(orgs, 1)
    sums = ",\n         ".join(
        f"sum(titles) FILTER (WHERE {holds(p)}) AS n_{p}" for p in range(orgs)
    )
    cells = ", ".join(f"{p}, n_{p}" for p in range(orgs))
    return f"""\
SELECT first.org AS a, second.org AS b, shared
FROM (SELECT a, stack({orgs}, {cells}) AS (b, shared) FROM (
  SELECT a,
         {sums}
  FROM (SELECT explode({positions(orgs)}) AS a, * FROM patterns WHERE keyed)
  GROUP BY a
)) AS pair
JOIN roster AS first ON pair.a = first.position
JOIN roster AS second ON pair.b = second.position
WHERE pair.a < pair.b AND shared > 0"""


def patterns(lake: Lake) -> DataFrame:
    return lake.table(
        "patterns", lambda: lake.sql(pattern_sql(lake.org_count), roster=lake.roster)
    )


def _over_patterns(lake: Lake, text: str) -> DataFrame:
    return lake.sql(text, patterns=patterns(lake), roster=lake.roster)


def corpus_totals(lake: Lake) -> DataFrame:
    """Records, distinct titles and orgs of the whole lake."""
    return _over_patterns(lake, TOTALS_SQL)


def org_titles(lake: Lake) -> DataFrame:
    """Distinct titles each org holds."""
    return _over_patterns(lake, org_titles_sql(lake.org_count))


ORG_RECORDS_SQL = "SELECT org, count(*) AS records FROM record_meta GROUP BY org"


def org_totals(lake: Lake) -> DataFrame:
    """Records and titles per org, with the last sync where the lake tracks it."""
    out = lake.sql(ORG_RECORDS_SQL).join(org_titles(lake), "org", "left")
    if lake.harvest_state is None:
        last = F.lit(None).cast("timestamp")
    else:
        out = out.join(lake.harvest_state, "org", "left")
        last = F.col("last_modified")
    return out.select("org", "records", "titles", last.alias("last_sync"))


def overlap_histogram(lake: Lake) -> DataFrame:
    """The rarity curve: titles held by exactly N orgs."""
    return _over_patterns(lake, histogram_sql(lake.org_count))


def uniqueness(lake: Lake) -> DataFrame:
    """Titles each org holds alone."""
    return _over_patterns(lake, uniqueness_sql(lake.org_count))


def overlap_pairwise(lake: Lake) -> DataFrame:
    """Titles both orgs of a pair hold, once per unordered pair that shares any."""
    return _over_patterns(lake, pairwise_sql(lake.org_count))


# --- holding patterns --------------------------------------------------------


def holding_patterns(lake: Lake, *, fold_rare: bool = False) -> DataFrame:
    """
    Titles per holding pattern, spelled out as the sorted list of holders.

    With ``fold_rare`` a pattern under the threshold is published only as part of its
    "held by N" group, which keeps the rarity curve and hides the set of holders.
    """
    names = lake.roster.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "org"))), lambda r: r["org"])
    )
    rows = (
        patterns(lake)
        .groupBy(*masks(lake.org_count))
        .agg(F.sum("titles").alias("titles"))
        .withColumn("names", names.scalar())
        .select(
            F.expr(f"transform({positions(lake.org_count)}, p -> element_at(names, p + 1))").alias("holders"),
            F.expr(holders(lake.org_count)).alias("n_holders"),
            "titles",
        )
    )
    if not fold_rare:
        return rows
    shown = F.when(F.col("titles") >= lake.params.threshold, F.col("holders"))
    return rows.groupBy(shown.alias("holders"), "n_holders").agg(F.sum("titles").alias("titles"))


def _within(lake: Lake, group: list[str]) -> F.Column:
    """How many orgs of the group are in a pattern."""
    rows = lake.roster.where(F.col("org").isin(list(group))).collect()
    missing = sorted(set(group) - {r["org"] for r in rows})
    if missing:
        raise ValueError("not in the lake: " + ", ".join(missing))
    return sum((F.expr(holds(r["position"])).cast("long") for r in rows), F.lit(0)).cast("long")


def group_overlap(lake: Lake, group: list[str]) -> DataFrame:
    """
    The rarity curve of a chosen group of orgs: for titles the group holds at all, how
    many are held by exactly k of its orgs.
    """
    return (
        patterns(lake)
        .where("keyed")
        .groupBy(_within(lake, group).alias("held_by"))
        .agg(F.sum("titles").alias("titles"))
        .where("held_by > 0")
    )


def group_shared(lake: Lake, group: list[str]) -> DataFrame:
    """Titles every org of the group holds."""
    everywhere = F.col("keyed") & (_within(lake, group) == len(set(group)))
    return patterns(lake).agg(
        F.coalesce(F.sum(F.when(everywhere, F.col("titles"))), F.lit(0)).alias("titles")
    )


def group_unique(lake: Lake, group: list[str]) -> DataFrame:
    """Per org of the group, the titles no other org of the group holds."""
    alone = patterns(lake).where(F.col("keyed") & (_within(lake, group) == 1))
    text = per_org_sql(lake.org_count, "titles", "true")
    rows = lake.sql(text, patterns=alone, roster=lake.roster)
    return rows.where(F.col("org").isin(list(group)))


# --- similarity --------------------------------------------------------------


def _sized_pairs(lake: Lake) -> DataFrame:
    """Every unordered pair of orgs with both title counts; unshared pairs count 0."""
    titles = org_titles(lake)
    others = titles.agg(F.collect_list(F.struct("org", "titles"))).scalar()
    every = (
        titles.withColumn("others", others)
        .select(F.col("org").alias("a"), F.col("titles").alias("a_titles"), F.explode("others").alias("o"))
        .select("a", "a_titles", F.col("o.org").alias("b"), F.col("o.titles").alias("b_titles"))
        .where("a < b")
    )
    return every.join(overlap_pairwise(lake), ["a", "b"], "left").withColumn(
        "shared", F.coalesce("shared", F.lit(0))
    )


def _ratio(part: str, whole: str) -> F.Column:
    return F.expr(f"CASE WHEN ({whole}) > 0 THEN {part} / CAST({whole} AS DOUBLE) END")


def jaccard(lake: Lake) -> DataFrame:
    """Shared titles over combined titles, per unordered pair."""
    return _sized_pairs(lake).select(
        "a", "b", "shared", _ratio("shared", "a_titles + b_titles - shared").alias("jaccard")
    )


def containment(lake: Lake) -> DataFrame:
    """Share of ``a``'s titles that ``b`` also holds, in both directions."""
    pairs = _sized_pairs(lake)
    flipped = pairs.select(
        F.col("b").alias("a"), F.col("a").alias("b"), "shared", F.col("b_titles").alias("a_titles")
    )
    return (
        pairs.select("a", "b", "shared", "a_titles")
        .unionByName(flipped)
        .select("a", "b", "shared", _ratio("shared", "a_titles").alias("containment"))
    )


MEASURES = {"jaccard": jaccard, "containment": containment, "shared": _sized_pairs}


def closest_pairs(lake: Lake, measure: str = "jaccard") -> DataFrame:
    """The pairs most alike on one measure, in rank order."""
    return (
        MEASURES[measure](lake)
        .select("a", "b", "shared", F.col(measure).cast("double").alias("measure"))
        .orderBy(F.desc_nulls_last("measure"), "a", "b")
        .limit(lake.params.closest_pairs)
    )


def similarity_matrix(lake: Lake, measure: str = "jaccard") -> DataFrame:
    """Every ordered pair of orgs, the diagonal blank."""
    values = MEASURES[measure](lake).select("a", "b", F.col(measure).cast("double").alias("value"))
    if measure != "containment":
        values = values.unionByName(values.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    diagonal = lake.roster.select(
        F.col("org").alias("a"), F.col("org").alias("b"), F.lit(None).cast("double").alias("value")
    )
    return values.unionByName(diagonal)
