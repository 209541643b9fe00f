"""
The org x category matrix behind every comparison, kept as long rows.

Input counts are ``(org, category, n)``, already aggregated; output rows are
``(org, category, cat_rank, n, total, share)`` for every org and every category on the
axis. ``n`` is NULL where the count is too small to publish and 0 where there is none;
``total`` is taken before both the axis cut and the suppression.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.functions import exprs


def fixed_axis(spark: SparkSession, categories) -> DataFrame:
    """A pinned axis: these categories in this order, present in the counts or not."""
    rows = ", ".join(f"({exprs.literal(c)}, {i})" for i, c in enumerate(categories, 1))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS axis(category, cat_rank)")


def ranked_axis(counts: DataFrame, top_k: int | None = None) -> DataFrame:
    """
    Categories by total over all orgs, largest first, ties by code; optionally the top k,
    of which each task keeps its own before they meet. What is ranked is an axis to be
    published, so it travels as one value and no partition has to hold all rows.
    """
    totals = counts.groupBy("category").agg(F.sum("n").alias("cat_total"))
    if top_k is not None:
        totals = totals.orderBy(F.desc("cat_total"), F.asc("category")).limit(top_k)
    ranks = F.array_sort(F.collect_list(F.struct(-F.col("cat_total"), F.col("category"))))
    placed = totals.agg(ranks.alias("ranks")).select(F.posexplode("ranks").alias("place", "rank"))
    return placed.select("rank.category", (F.col("place") + 1).alias("cat_rank"))


def org_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("org").agg(F.sum("n").alias("total"))


def dense_grid(axis: DataFrame, orgs: DataFrame) -> DataFrame:
    """
    Every org on every row of the axis. Both are published dimensions (an org roster and
    a capped or closed vocabulary), so the roster travels as one array value.
    """
    names = [F.col(c) for c in orgs.columns]
    roster = orgs.agg(F.collect_list(F.struct(*names))).scalar()
    return (
        axis.withColumn("roster", roster)
        .withColumn("o", F.explode("roster"))
        .select(*axis.columns, "o.*")
    )


def matrix(
    counts: DataFrame,
    threshold: int,
    *,
    axis: DataFrame | None = None,
    top_k: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """
    Shape counts into the matrix. ``axis`` pins the categories; ``totals`` overrides the
    denominators, so that a display cut never inflates a share, and with them the rows.
    """
    if axis is None:
        axis = ranked_axis(counts, top_k)
    if totals is None:
        totals = org_totals(counts)
    cells = dense_grid(axis, totals).join(counts, ["org", "category"], "left")
    n = F.coalesce("n", F.lit(0))
    return cells.withColumn("n", n).select(
        "org",
        "category",
        F.col("cat_rank").cast("int").alias("cat_rank"),
        F.expr(exprs.published("n", threshold)).alias("n"),
        F.col("total").cast("long").alias("total"),
        F.expr(
            f"CASE WHEN total > 0 THEN ({exprs.published('n', threshold)}) / CAST(total AS DOUBLE) END"
        ).alias("share"),
    )


def matrix_of_cells(counts: DataFrame, threshold: int, *, axis: Column | None = None) -> DataFrame:
    """
    The same shape from held counts, ``(org, category, n)`` with or without ``total``: an
    org's cells become a map, and one explode of the axis makes the grid. ``axis`` is an array
    of categories; without it, categories by total, largest first, ties by code. Axes are
    published, and so short enough to travel as one value.
    """
    if "total" not in counts.columns:
        counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("org")))
    if axis is None:
        sized = counts.groupBy("category").agg(F.sum("n").alias("all"))
        ranks = F.array_sort(F.collect_list(F.struct(-F.col("all"), F.col("category"))))
        axis = sized.agg(F.transform(ranks, lambda r: r["category"])).scalar()
    by_org = counts.groupBy("org").agg(
        F.first("total").cast("long").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("_cells"),
    )
    cells = by_org.withColumn("_axis", axis).select("org", "total", "_cells", F.posexplode("_axis").alias("_place", "category"))
    shown = F.expr(exprs.published("n", threshold))
    return (
        cells.withColumn("n", F.coalesce(F.col("_cells")[F.col("category")], F.lit(0)))
        .withColumn("share", F.when(F.col("total") > 0, shown / F.col("total").cast("double")))
        .select("org", "category", (F.col("_place") + 1).alias("cat_rank"), shown.alias("n"), "total", "share")
    )


def without_totals(cells: DataFrame) -> DataFrame:
    """
    Withhold denominators where the categories exhaust them: beside the other cells
    a published total would give a suppressed one away by subtraction.
    """
    return cells.drop("total", "share")


def share_rows(cells: DataFrame, exclude=()) -> DataFrame:
    """Matrix rows less some categories; shares keep the full denominator."""
    return cells.where(~F.col("category").isin(list(exclude))) if exclude else cells
