"""
Holding patterns by decade, language and format: whose titles, and which.

A title has as many descriptions as records, and they may differ, so each attribute is
elected: the value that most of its records give, of equal ones the least. One pass over
titles gives the pattern and the elected attributes together, and counts of titles by all
four are the table that every cube and every question about a group is read from.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelftally.functions import exprs as x
from shelftally.operators.overlap import WORD, holders, holds, masks, positions
from shelftally.params import Params
from shelftally.sources.lake import Lake

ATTRIBUTES = ("decade", "language", "format")


def attributes_sql(p: Params) -> str:
    """Per record the attributes in its first leader and first field 008."""
    low, high = p.publication_years
    first = f"min(CASE WHEN tag = '008' THEN named_struct('field_seq', {x.sequence('field_seq')}, 'date1', {x.piece(x.DATE_1)}, 'language', {x.piece(x.LANGUAGE)}) END)"
    leader = f"min(CASE WHEN tag = 'LDR' AND length(value) >= 7 THEN named_struct('field_seq', {x.sequence('field_seq')}, 'format', {x.piece(x.RECORD_TYPE)}) END)"
    published = x.year("first.date1")
    return f"""\
SELECT org, record_id,
       CASE WHEN {published} BETWEEN {low} AND {high} THEN {x.decade(published)} END AS decade,
       nullif(upper({x.stripped('first.language')}), '') AS language,
       nullif({x.stripped('leader.format')}, '') AS format
FROM (
  SELECT org, record_id, {first} AS first, {leader} AS leader
  FROM records
  WHERE tag IN ('LDR', '008') AND record_id IS NOT NULL
  GROUP BY org, record_id
)"""


def facets_sql(orgs: int) -> str:
    """
    Titles by pattern and elected attributes. Patterns and votes combine before the shuffle
    by title: a vote is a count for each value, so a title that a third of all records name
    is a short list of values by the time it is shuffled.
    """
    key = ", ".join(masks(orgs))
    bits = ",\n         ".join(
        f"coalesce(bit_or(CASE WHEN position div {WORD} = {w}"
        f" THEN shiftleft(1L, CAST(position % {WORD} AS INT)) END), 0L) AS {mask}"
        for w, mask in enumerate(masks(orgs))
    )
    elected = ",\n         ".join(f"mode() WITHIN GROUP (ORDER BY {a}) AS {a}" for a in ATTRIBUTES)
    return f"""\
SELECT {key}, {', '.join(ATTRIBUTES)}, count(*) AS titles
FROM (
  SELECT title_key,
         {bits},
         {elected}
  FROM record_meta LEFT JOIN roster USING (org) LEFT JOIN record_attributes USING (org, record_id)
  WHERE title_key IS NOT NULL
  GROUP BY title_key
)
GROUP BY ALL"""


def steps(lake: Lake) -> list[tuple[str, str]]:
    return [
        ("Attributes of each record", f"CREATE OR REPLACE TEMP VIEW record_attributes AS\n{attributes_sql(lake.params)}"),
        ("Titles by pattern and elected attributes", f"CREATE OR REPLACE TEMP VIEW title_facets AS\n{facets_sql(lake.org_count)}"),
    ]


def title_facets(lake: Lake) -> DataFrame:
    def build() -> DataFrame:
        attributes = lake.sql(attributes_sql(lake.params))
        return lake.sql(facets_sql(lake.org_count), roster=lake.roster, record_attributes=attributes)

    return lake.table("title_facets", build)


def _named(lake: Lake, rows: DataFrame) -> DataFrame:
    """Holders by name in place of the mask words; none where the words are NULL."""
    names = lake.roster.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "org"))), lambda r: r["org"]))
    words = masks(lake.org_count)
    spelled = F.expr(f"transform({positions(lake.org_count)}, p -> element_at(names, p + 1))")
    out = rows.withColumn("names", names.scalar()).withColumn("holders", F.when(F.col(words[0]).isNotNull(), spelled))
    return out.drop("names", *words)


def cube_sql(orgs: int) -> str:
    """Every subset of the attributes under every pattern; ``parts`` has a bit for each attribute that is told apart."""
    key = ", ".join(masks(orgs))
    told = " + ".join(f"(1 - grouping({a})) * {1 << i}" for i, a in enumerate(ATTRIBUTES))
    return f"""\
SELECT {key}, {holders(orgs)} AS n_holders, {', '.join(ATTRIBUTES)}, CAST({told} AS INT) AS parts, sum(titles) AS titles
FROM title_facets
GROUP BY {key}, CUBE ({', '.join(ATTRIBUTES)})"""


def pattern_cube(lake: Lake) -> DataFrame:
    """
    Titles by holders and every subset of decade, language and format. Where ``parts`` has
    the bit of an attribute (1, 2, 4), NULL means unknown; elsewhere all its values are in.
    """
    rows = lake.sql(cube_sql(lake.org_count), title_facets=title_facets(lake))
    return _named(lake, rows)


def pattern_cube_folded(lake: Lake) -> DataFrame:
    """
    The finest cells that may be published. A cell under the threshold gives up its format,
    then its language, its decade and its holders, and what meets there is counted together,
    so every title is in one row. ``depth`` tells how much is kept: 4 all, 1 the holders, 0
    their number alone, which is published at any size, as the rarity curve is.
    """
    words = masks(lake.org_count)
    facets = title_facets(lake)
    types = dict(facets.dtypes)
    rest = facets.withColumn("n_holders", F.expr(holders(lake.org_count)))
    told = ["n_holders", *words, *ATTRIBUTES]

    def level(rows: DataFrame, by: list[str], depth: int) -> DataFrame:
        columns = [F.col(c) if c in by else F.lit(None).cast(types[c]).alias(c) for c in told]
        return rows.select(*columns, F.lit(depth).alias("depth"), "titles")

    out = None
    for depth in range(len(ATTRIBUTES) + 1, 0, -1):
        by = ["n_holders", *words, *ATTRIBUTES[: depth - 1]]
        shown = level(rest.where(F.col("titles") >= lake.params.threshold), by, depth)
        out = shown if out is None else out.unionAll(shown)
        # the last of them goes: an attribute, or at the end the holders
        by = by[:-1] if depth > 1 else ["n_holders"]
        rest = rest.where(F.col("titles") < lake.params.threshold).groupBy(*by).agg(F.sum("titles").alias("titles"))
    return _named(lake, out.unionAll(level(rest, ["n_holders"], 0)))


def group_unique_by(lake: Lake, group: list[str], attribute: str) -> DataFrame:
    """Per org of a group, titles that no other org of the group holds, by one attribute."""
    if attribute not in ATTRIBUTES:
        raise ValueError(f"{attribute} is none of {', '.join(ATTRIBUTES)}")
    rows = lake.roster.where(F.col("org").isin(list(group))).collect()
    missing = sorted(set(group) - {r["org"] for r in rows})
    if missing:
        raise ValueError("not in the lake: " + ", ".join(missing))
    held = {r["org"]: F.expr(holds(r["position"])) for r in rows}
    within = sum((h.cast("int") for h in held.values()), F.lit(0))
    holder = F.coalesce(*(F.when(h, F.lit(org)) for org, h in held.items()))
    alone = title_facets(lake).where(within == 1)
    return alone.groupBy(holder.alias("org"), attribute).agg(F.sum("titles").alias("titles"))
