"""
Differencing audit: which withheld counts follow from the figures published beside them.

Withholding a small count is not enough where a total stands next to it: the total less the
other cells is the hidden one. Here published tables become cells with bounds, a withheld
count being some number from 1 to threshold - 1, and linear relations between cells. Bounds
are tightened along the relations until nothing moves; a withheld cell whose bounds meet can
be worked out. ``protect`` withholds a second cell beside it, or the total where there is none.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.operators import comparison, provenance, serials
from shelftally.sources.lake import Lake, cut

SMALL, BESIDE = "small", "beside"


@dataclass(frozen=True)
class Margin:
    """A published matrix whose cells add up to the ``total`` beside them."""

    build: Callable[[Lake], DataFrame]
    #: The axis may end here: with that many categories shown there may be more.
    longest_axis: int | None = None


def margins(lake: Lake) -> dict[str, Margin]:
    """The matrices whose denominators are the sums of their categories, by report."""
    p = lake.params
    return {
        "language": Margin(comparison.lang_matrix, p.compare_top_k),
        "country": Margin(comparison.country_matrix, p.compare_top_k),
        "record_type": Margin(comparison.record_type_matrix, p.compare_top_k),
        "lc_class": Margin(comparison.lc_class),
        "lc_class_serial": Margin(comparison.lc_class_serial),
        "serial_status": Margin(serials.serial_status, p.compare_top_k),
        "mod_depth": Margin(provenance.cat_mod_depth),
    }


# --- bounds along relations ----------------------------------------------------


def tighten(cells: DataFrame, terms: DataFrame, relations: DataFrame) -> DataFrame:
    """
    One round: each relation's bounds on its cells, given the present bounds of the others.

    ``cells``: ``cell``, ``low``, ``high``. ``terms``: ``relation``, ``cell``, ``sign`` (1 or
    -1), once for each pair. ``relations``: ``relation``, ``least``, ``most`` of the signed
    sum. A bound that is NULL is open.
    """
    down, up = F.col("sign") > 0, F.col("sign") < 0
    signed = terms.join(cells, "cell").withColumns(
        {
            "a": F.when(down, F.col("low")).when(up, -F.col("high")),
            "b": F.when(down, F.col("high")).when(up, -F.col("low")),
        }
    )
    within = Window.partitionBy("relation")

    def rest(bound: str) -> Column:
        """The sum of the other terms' bounds; open where one of them is."""
        others = F.count("*").over(within) - 1
        known = F.count(bound).over(within) - F.when(F.col(bound).isNotNull(), 1).otherwise(0)
        whole = F.coalesce(F.sum(bound).over(within), F.lit(0))
        return F.when(known == others, whole - F.coalesce(bound, F.lit(0)))

    sums = signed.withColumns({f"rest_{c}": rest(c) for c in "ab"})
    told = sums.join(relations, "relation").select(
        "cell", "sign", (F.col("least") - F.col("rest_b")).alias("bottom"), (F.col("most") - F.col("rest_a")).alias("top")
    )
    found = told.groupBy("cell").agg(
        F.max(F.when(down, F.col("bottom")).otherwise(-F.col("top"))).alias("floor"),
        F.min(F.when(down, F.col("top")).otherwise(-F.col("bottom"))).alias("ceiling"),
    )
    # greatest and least pass over a NULL
    return cells.join(found, "cell", "left").select(
        "cell", F.greatest("low", "floor").alias("low"), F.least("high", "ceiling").alias("high")
    )


def propagate(cells: DataFrame, terms: DataFrame, relations: DataFrame, rounds: int = 100) -> DataFrame:
    """
    Bounds that no relation can tighten further. Cells are those of reports, so a round is
    small; each is cut off from the one before, and rounds end because bounds are whole
    numbers that only move inwards.
    """
    known = cells.select("cell", "low", "high")
    for _ in range(rounds):
        after = cut(tighten(known, terms, relations))
        moved = known.select("cell", F.col("low").alias("_low"), F.col("high").alias("_high")).join(after, "cell")
        same = F.col("low").eqNullSafe(F.col("_low")) & F.col("high").eqNullSafe(F.col("_high"))
        settled = moved.where(~same).isEmpty()
        known = after
        if settled:
            break
    return known


# --- the published reports -------------------------------------------------------


def published(lake: Lake) -> DataFrame:
    """Every cell of the audited reports: ``report``, ``org``, ``category``, ``n``, ``total`` and whether its axis is whole."""

    def build() -> DataFrame:
        out = None
        for report, margin in margins(lake).items():
            rows = margin.build(lake)
            shown = F.max("cat_rank").over(Window.partitionBy("org"))
            whole = F.lit(True) if margin.longest_axis is None else shown < margin.longest_axis
            rows = rows.select(F.lit(report).alias("report"), "org", F.col("category").cast("string").alias("category"), "n", "total", whole.alias("whole"))
            out = rows if out is None else out.unionAll(rows)
        return out

    return lake.keep("published_cells", build)


def _cell() -> Column:
    return F.concat_ws("\x1f", "report", "org", "category")


def _relation() -> Column:
    return F.concat_ws("\x1f", "report", "org")


def bounds(rows: DataFrame, threshold: int) -> DataFrame:
    """
    ``rows`` with what a reader can tell of each withheld cell: ``low`` and ``high``.

    ``rows`` are those of ``published`` or of ``protect``. A reader may know how cells are
    chosen, so one withheld beside another is taken as ``threshold`` or more, and never
    helps to hide less than it should. A total of NULL tells nothing, and that of an axis
    which may be cut is only an upper bound. Each org's row of a report is one relation.
    """
    beside = F.col("withheld") == BESIDE if "withheld" in rows.columns else F.lit(False)
    low = F.when(F.col("n").isNotNull(), F.col("n")).when(beside, threshold).otherwise(1)
    high = F.when(F.col("n").isNotNull(), F.col("n")).when(~beside, threshold - 1)
    cells = rows.select(_cell().alias("cell"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    terms = rows.select(_relation().alias("relation"), _cell().alias("cell"), F.lit(1).alias("sign"))
    sums = rows.groupBy(_relation().alias("relation")).agg(F.first("total").alias("most"), F.first("whole").alias("whole"))
    relations = sums.select("relation", F.when(F.col("whole"), F.col("most")).alias("least"), "most")
    known = propagate(cells, terms, relations)
    return rows.withColumn("cell", _cell()).join(known, "cell").drop("cell")


def _solved(rows: DataFrame) -> DataFrame:
    return rows.where("n IS NULL AND low = high").select("report", "org", "category", F.col("low").alias("value"))


def recoverable_cells(lake: Lake) -> DataFrame:
    """Withheld cells of the published reports that follow from the figures beside them, with their value."""
    return _solved(bounds(published(lake), lake.params.threshold))


def protect(rows: DataFrame, threshold: int, by=("report", "org")) -> DataFrame:
    """
    Withhold enough beside the small cells that none can be worked out.

    An org's hidden cells, ``k`` of them, sum to a known rest. They can be told where the rest
    leaves one choice: one cell, all ones, or all ``threshold - 1``. There the smallest shown
    count goes too that leaves a choice even to a reader who knows it is at least
    ``threshold``; where no count does, the total goes. ``withheld`` says why a cell is NULL,
    and ``total`` is NULL where it is withheld.
    """
    whole = F.col("whole") if "whole" in rows.columns else F.lit(True)
    org = Window.partitionBy(*by)
    hidden = F.count(F.when(F.col("n").isNull(), 1)).over(org)
    rest = F.col("total") - F.coalesce(F.sum("n").over(org), F.lit(0))
    told = rows.withColumns({"_k": hidden, "_rest": rest})
    most = F.col("_k") * (threshold - 1)
    exposed = (F.col("_k") > 0) & ((F.col("_rest") == F.col("_k")) | (whole & ((F.col("_k") == 1) | (F.col("_rest") == most))))
    hides = (F.col("n") >= threshold) & (F.col("_rest") + F.col("n") > threshold + F.col("_k"))
    place = F.row_number().over(Window.partitionBy(*by, "_hides").orderBy("n", "category"))
    picked = told.withColumns({"_exposed": exposed, "_hides": exposed & F.coalesce(hides, F.lit(False))}).withColumn("_place", place)
    beside = F.col("_hides") & (F.col("_place") == 1)
    no_cell = F.col("_exposed") & (F.max("_hides").over(org) == F.lit(False))
    reason = F.when(F.col("n").isNull(), SMALL).when(beside, BESIDE)
    out = picked.withColumns({"withheld": reason, "total": F.when(~no_cell, F.col("total"))})
    return out.withColumn("n", F.when(~beside, F.col("n"))).select(*rows.columns, "withheld")


def protected_cells(lake: Lake) -> DataFrame:
    """The audited reports after the second pass."""
    return protect(published(lake), lake.params.threshold).drop("whole")


def protected(table: DataFrame, threshold: int, longest_axis: int | None = None) -> DataFrame:
    """One published matrix after the second pass; its shares follow its counts."""
    shown = F.max("cat_rank").over(Window.partitionBy("org"))
    whole = F.lit(True) if longest_axis is None else shown < longest_axis
    out = protect(table.withColumn("whole", whole), threshold, by=["org"])
    share = F.when(F.col("n").isNotNull() & F.col("total").isNotNull(), F.col("share"))
    return out.withColumn("share", share).drop("whole", "withheld")


def disclosure_audit(lake: Lake) -> DataFrame:
    """Per report: cells withheld, those that can be worked out, what the second pass withholds, and what it leaves."""
    threshold = lake.params.threshold
    before = bounds(published(lake), threshold)
    guarded = protect(published(lake), threshold)
    after = bounds(guarded, threshold)
    solved = F.col("n").isNull() & (F.col("low") == F.col("high"))
    orgs = F.count_distinct(F.when(F.col("total").isNull(), F.col("org")))
    return (
        before.groupBy("report")
        .agg(F.count_if(F.col("n").isNull()).alias("withheld"), F.count_if(solved).alias("recoverable"))
        .join(
            after.groupBy("report").agg(
                F.count_if(F.col("withheld") == BESIDE).alias("beside"), orgs.alias("totals"), F.count_if(solved).alias("recoverable_after")
            ),
            "report",
        )
    )
