"""
Disclosure control: no count in 1..threshold-1 is published on its own.

Each function takes counts that are already aggregated and works per group of the
``by`` columns. Folded cells go to one ``Other`` row, which is exempt because it stands
for many records.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OTHER = "Other"


class ReconciliationError(ValueError):
    """Published parts do not add up to the whole they were cut from."""


def bucket_top_n(
    counts: DataFrame,
    *,
    n: int,
    threshold: int,
    by=(),
    label: str = "category",
    count: str = "n",
    other: str = OTHER,
) -> DataFrame:
    """
    Keep the top ``n`` rows of each group that reach the threshold; the rest becomes
    ``other``. ``cat_rank`` gives the published order, ``other`` last.
    """
    by = list(by)
    order = [F.desc(count), F.asc(label)]
    large = counts.where(F.col(count) >= threshold)
    # a rank limit over a window: each task keeps at most n rows per group before the
    # shuffle, so a group with a long tail is never sorted whole
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = large.withColumn("cat_rank", rank).where(F.col("cat_rank") <= n)
    kept = kept.select(*by, F.col(label).cast("string").alias(label), count, "cat_rank")
    published = kept.groupBy(*by).agg(F.sum(count).alias("_kept"))
    whole = counts.groupBy(*by).agg(F.sum(count).alias("_all"))
    rest = whole.join(published, by, "left") if by else whole.withColumn("_kept", F.lit(0))
    if not by:
        rest = whole.withColumn("_kept", published.select(F.coalesce("_kept", F.lit(0))).scalar())
    folded = rest.select(
        *by,
        F.lit(other).alias(label),
        (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias(count),
        F.lit(n + 1).alias("cat_rank"),
    ).where(F.col(count) > 0)
    return kept.unionByName(folded)


def fold_small(
    counts: DataFrame,
    *,
    threshold: int,
    by=(),
    label: str = "category",
    count: str = "n",
    other: str = OTHER,
) -> DataFrame:
    """Fold only the small cells; every other bucket stays. One aggregation, no ranking."""
    name = F.when(F.col(count) >= threshold, F.col(label).cast("string")).otherwise(other)
    return (
        counts.groupBy(*by, name.alias(label))
        .agg(F.sum(count).alias(count))
        .where(F.col(count) > 0)
    )


def fold_into(
    counts: DataFrame,
    *,
    threshold: int,
    by=(),
    label: str = "category",
    count: str = "n",
    other: str = "other",
) -> DataFrame:
    """Move small buckets into the existing ``other`` bucket, conserving the total."""
    small = (F.col(count) > 0) & (F.col(count) < threshold) & (F.col(label) != other)
    name = F.when(small, F.lit(other)).otherwise(F.col(label))
    return counts.groupBy(*by, name.alias(label)).agg(F.sum(count).alias(count))


def fold_columns(wide: DataFrame, buckets, *, threshold: int, other: str = "other") -> DataFrame:
    """``fold_into`` where the buckets are columns of one row."""
    small = {b: (F.col(b) > 0) & (F.col(b) < threshold) for b in buckets if b != other}
    moved = F.col(other)
    for bucket, is_small in small.items():
        moved = moved + F.when(is_small, F.col(bucket)).otherwise(0)
    kept = {b: F.when(is_small, F.lit(0)).otherwise(F.col(b)) for b, is_small in small.items()}
    return wide.withColumns(kept | {other: moved})


def small_cells(
    counts: DataFrame,
    *,
    threshold: int,
    label: str = "category",
    count: str = "n",
    other: str = OTHER,
) -> DataFrame:
    """Cells that leaked through: counts in 1..threshold-1 outside ``other``. Must be empty."""
    return counts.where(
        ~F.col(label).eqNullSafe(F.lit(other)) & (F.col(count) > 0) & (F.col(count) < threshold)
    )


def require_reconciled(parts: DataFrame, whole: DataFrame, *, by: str, what: str) -> None:
    """Raise unless ``parts.n`` equals ``whole.n`` for every ``by``; one small join."""
    wrong = (
        parts.select(by, F.col("n").alias("covered"))
        .join(whole.select(by, F.col("n").alias("held")), by, "full")
        .where(~F.coalesce("covered", F.lit(0)).eqNullSafe(F.coalesce("held", F.lit(0))))
        .orderBy(by)
        .collect()
    )
    if wrong:
        raise ReconciliationError(
            f"{what}: "
            + "; ".join(f"{r[by]} covers {r['covered'] or 0} of {r['held'] or 0}" for r in wrong)
        )
