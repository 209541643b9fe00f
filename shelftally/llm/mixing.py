"""
Mixing sources to target weights by pivotal rounding.

A document of a source with target T and size S is due T / S copies. Its whole copies are
certain; the fractions are rounded in pairs. Of a pair, mass (copies times words) moves at
random from one to the other until one of them is integral, so their expected copies and
the words of the pair stay as they were. Pairs are met inside groups of a fixed size; what
is left of a group, one fraction, meets the residuals of other groups one level up, until
one fraction per source is left for a coin. Draws are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3.0
#: Units that meet in one group at each level of the reduction tree.
FAN_IN = 256
SEED = 9
_EPS = 1e-9


def _source_key(column: str = "source") -> Column:
    """A source as a key that is never null and sorts by code point, null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``key``, ``source_size``, ``target`` of every source in ``sizes`` (``key``, ``source_size``), one row each.

    Targets share all words by weight, but none exceeds ``most`` times its source. Sources
    are filled in the order in which their limits are met: a source is at its limit where
    that limit is no more than its share of what the sources before it have left. There is
    one row per source, and the windows run over those alone.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("key"))).withColumn("weight", weight)
    ranked = ranked.withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    share = ranked.withColumn("level", left / F.sum("weight").over(after))
    full = share.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    # beyond the first source below its limit, all share the level that holds there
    held = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), F.col("limit")).otherwise(held * F.col("weight"))
    return full.select("key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _draw(*what) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *what), F.lit(1 << 52)) / float(1 << 52)


def _meet(held: Column, other: Column) -> Column:
    """One pivotal step between the held fraction and another: what is decided, and what is held next.

    With mass a = p * words: either one gives the other all it lacks or all its own. The
    chances are those that keep the expected p of both. A unit without words, or that is
    integral already, is decided at once by its own fraction.
    """
    m, w = held["p"] * held["words"], held["words"]
    n, v = other["p"] * other["words"], other["words"]
    to_other = F.least(m, v - n)  # mass that held can give
    to_held = F.least(n, w - m)
    give = other["u"] * (to_other + to_held) < to_held
    a = F.when(give, m - to_other).otherwise(m + to_held) / w
    b = F.when(give, n + to_other).otherwise(n - to_held) / v
    a_done = (a < _EPS) | (a > 1 - _EPS)
    rest = F.when(a_done, b).otherwise(a)
    done = F.struct(F.when(a_done, held["at"]).otherwise(other["at"]).alias("at"), F.round(F.when(a_done, a).otherwise(b)).cast("int").alias("copy"))
    unit = F.struct(
        F.when(a_done, other["at"]).otherwise(held["at"]).alias("at"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest)).alias("p"),
        F.when(a_done, v).otherwise(w).alias("words"),
        other["u"].alias("u"),
    )
    return F.struct(unit.alias("held"), done.alias("done"))


def _round_groups(units: DataFrame) -> DataFrame:
    """Fold each group of ``units`` (``key``, ``group``, ``at``, ``p``, ``words``, a draw ``u``, an order ``place``): decisions and one residual."""
    # long documents first: they become integral while many others are left to meet
    unit = F.struct((-F.col("words")).alias("first"), "place", "at", "p", "words", "u")
    grouped = units.groupBy("key", "group").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    none = "CAST(NULL AS STRUCT<at: BIGINT, p: DOUBLE, words: DOUBLE, u: DOUBLE>)"
    start = F.struct(F.expr(none).alias("held"), F.expr("CAST(array() AS ARRAY<STRUCT<at: BIGINT, copy: INT>>)").alias("done"))

    def step(state: Column, unit: Column) -> Column:
        ordered = F.struct(unit["at"].alias("at"), unit["p"].alias("p"), unit["words"].alias("words"), unit["u"].alias("u"))
        integral = (unit["p"] < _EPS) | (unit["p"] > 1 - _EPS) | (unit["words"] <= 0)
        sure = F.struct(unit["at"].alias("at"), F.when(unit["p"] > unit["u"], 1).otherwise(0).cast("int").alias("copy"))
        met = _meet(state["held"], ordered)
        return (
            F.when(integral, F.struct(state["held"].alias("held"), F.array_append(state["done"], sure).alias("done")))
            .when(state["held"].isNull(), F.struct(ordered.alias("held"), state["done"].alias("done")))
            .otherwise(F.struct(met["held"].alias("held"), F.array_append(state["done"], met["done"]).alias("done")))
        )

    return grouped.select("key", "group", F.aggregate("units", start, step).alias("r")).select(
        "key", "group", F.col("r.held").alias("held"), F.col("r.done").alias("done")
    )


def pivotal(units: DataFrame, most: int, fan_in: int = FAN_IN) -> DataFrame:
    """``key``, ``unit``, ``copy`` (0 or 1) for ``units`` (``key``, ``unit``, ``p`` in [0, 1], ``words``).

    ``unit`` is a distinct number within its key, and ``most`` no less than the units of any
    key. Groups are dealt by hash, about ``fan_in`` units in each whatever the number of
    units, so a key with many units is spread over as many groups.
    """
    number = units.groupBy("key").agg(F.count("*").alias("n"))
    level = common.with_facts(units.select("key", F.col("unit").alias("at"), "p", "words"), number, "key", F.col("at"))
    decided, depth = [], 0
    while True:  # one round for each level of the tree
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long")
        group = F.pmod(F.xxhash64(F.lit(depth), "key", "at"), groups)
        dealt = level.select(
            "key", group.alias("group"), "at", "p", "words", _draw(F.lit(depth), "key", "at").alias("u"), F.xxhash64("at", F.lit(depth)).alias("place")
        )
        folded = common.cut(_round_groups(dealt))
        decided.append(folded.select("key", F.explode("done").alias("d")).select("key", F.col("d.at").alias("unit"), F.col("d.copy").alias("copy")))
        left = folded.where("held IS NOT NULL").select("key", F.col("held.at").alias("at"), F.col("held.p").alias("p"), F.col("held.words").alias("words"))
        depth += 1
        most = -(-most // fan_in)
        if most <= 1:
            break
        level = common.with_facts(left, left.groupBy("key").agg(F.count("*").alias("n")), "key", F.col("at"))
    # one group per key was left: its residual meets a coin
    coin = F.when(_draw(F.lit(-1), "key", "at") < F.col("p"), 1).otherwise(0).cast("int")
    out = left.select("key", F.col("at").alias("unit"), coin.alias("copy"))
    for rows in decided:
        out = out.unionAll(rows)
    return out


def plan(docs: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Copies that the mix takes of every document of ``docs`` (``doc_id``, ``text``, ``source``).

    ``doc_id``, ``source``, ``size``, ``rows``, ``source_size``, ``target``, ``copies``. Rows
    that repeat an id, source and size are one unit of ``rows`` rows, which are taken alike. A
    null text has no words, and a document without words is due copies as any other. A source
    without words has the target 0 and gets no copies.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.words(F.col("text")).alias("size"))
    rows = common.cut(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")).withColumn("key", _source_key()))
    totals = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    due = common.cut(targets(totals, weights, most))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = common.with_facts(rows, due, "key", F.col("doc_id")).withColumn("rate", rate)
    # documents whose numbers should ever be equal are one unit, as repeated rows are
    rows = rows.withColumn("unit", F.xxhash64("doc_id", "size", F.col("doc_id").isNull()))
    fraction = F.col("rate") - F.floor("rate")
    units = rows.groupBy("key", "unit").agg(F.first(fraction).alias("p"), F.sum(F.col("size") * F.col("rows")).cast("double").alias("words"))
    largest = units.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    chosen = pivotal(units, largest).withColumnsRenamed({"key": "__key", "unit": "__unit"})
    return rows.join(chosen, (F.col("key") == F.col("__key")) & (F.col("unit") == F.col("__unit"))).select(
        "doc_id", "source", "size", "rows", "source_size", "target", (F.floor("rate").cast("long") + F.col("copy")).alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: what the mix takes of it."""
    return (
        plan(docs, **options)
        .withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, as often as the mix takes them."""
    *mine, turn = common.free_names(docs.columns, "taken_id", "taken_source", "taken_size", "taken_copies", "turn")
    id_, source, size, times = mine
    copies = plan(docs, **options).select(*(F.col(c).alias(a) for c, a in zip(("doc_id", "source", "size", "copies"), mine, strict=True)))
    joined = docs.join(
        copies.where(F.col(times) > 0),
        common.same(F.col("doc_id").cast("long"), F.col(id_))
        & common.same(F.col("source").cast("string"), F.col(source))
        & (common.words(F.col("text")) == F.col(size)),
    )
    again = joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return again.drop(*mine, turn)
