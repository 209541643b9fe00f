"""
Exact lists of the most frequent values per group, without shuffling the tail.

A first pass keeps a mergeable summary of frequent items for each group: a fixed number of
counters, whatever the number of values. A second pass counts the candidates alone, exactly.
A value that is no candidate cannot be more frequent than the summary's error allows; where
that does not settle the list of a group, the group is counted in full.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.sources.lake import cut

#: Counters of a summary, and the candidates that it names for each place of a list.
TRACKED = 4096
CANDIDATES = 4
#: An item's count is underestimated by at most this share of all items, over the number of counters.
ERROR = 3.5


def candidates(rows: DataFrame, by: str, value: str, wanted: int, tracked: int = TRACKED) -> DataFrame:
    """
    ``by``, ``value`` and ``most``: values that may be frequent, and what any other value of
    the group reaches at most. At most ``wanted`` rows for each group.
    """
    state = F.call_function("approx_top_k_accumulate", F.col(value), F.lit(tracked))
    found = rows.groupBy(by).agg(F.count("*").alias("_all"), state.alias("_state"))
    listed = found.withColumn("_top", F.call_function("approx_top_k_estimate", F.col("_state"), F.lit(wanted)))
    # if the list is full, what is not on it is estimated no higher than its last entry
    last = F.when(F.size("_top") >= wanted, F.array_min(F.transform("_top", lambda t: t["count"]))).otherwise(0)
    unseen = F.floor(F.col("_all") * ERROR / tracked)
    out = listed.select(by, F.greatest(last, unseen).cast("long").alias("most"), F.explode("_top").alias("_t"))
    return out.select(by, F.col("_t.item").alias(value), "most")


def _ranked(counts: DataFrame, by: str, value: str, k: int, at_least: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.asc(value)))
    return counts.where(F.col("n") >= at_least).withColumn("place", place).where(F.col("place") <= k)


def top_values(rows: DataFrame, by: str, value: str, k: int, at_least: int = 1, tracked: int = TRACKED) -> DataFrame:
    """
    The ``k`` most frequent values of each group that occur ``at_least`` so often: ``by``,
    ``value``, ``n``, ``place``; ties by value. NULL is no value. ``rows`` is read twice.
    """
    rows = rows.where(F.col(value).isNotNull()).select(by, value)
    likely = cut(candidates(rows, by, value, CANDIDATES * k, tracked))  # a few for each group
    counts = rows.join(F.broadcast(likely), [by, value]).groupBy(by, value).agg(F.count("*").alias("n"), F.first("most").alias("most"))
    listed = cut(_ranked(counts, by, value, k, at_least))
    # a list is settled if nothing unlisted can reach its last place, or the least count
    ends = listed.groupBy(by).agg(F.count("*").alias("_places"), F.min("n").alias("_last"))
    limits = likely.groupBy(by).agg(F.first("most").alias("_most")).join(ends, by, "left")
    settled = (F.col("_most") < at_least) | ((F.coalesce("_places", F.lit(0)) == k) & (F.col("_most") < F.col("_last")))
    judged = cut(limits.select(by, F.coalesce(settled, F.lit(False)).alias("settled")))
    done = listed.drop("most").join(judged.where("settled"), by, "left_semi")
    again = rows.join(judged.where("NOT settled").select(by), by, "left_semi")
    return done.unionByName(_ranked(again.groupBy(by, value).agg(F.count("*").alias("n")), by, value, k, at_least))
