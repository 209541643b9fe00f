"""
Near duplicates by SimHash, compared exactly in tiles.

Distinct fingerprints are compared, not documents. Fingerprints within the radius agree in
all but ``RADIUS`` of ``BLOCKS`` blocks of bits, so each is listed under every choice of
blocks that may agree, and only fingerprints of one list are compared. A list is compared in
tiles: exclusive-or and bit counts of whole arrays, for pairs of tiles whose population
counts are within the radius. Lists longer than a tile are split over tasks by population
count and salt, so no list has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
#: Fingerprints compared at a time, and the longest list that one task takes whole.
TILE = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shingles(text: bytes, width: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text joined by one space, and where its shingles start and end in that."""
    parts = text.translate(_TABLE).split()
    joined = b" ".join(parts)
    if not parts:
        return joined, [], []
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(parts) < width:
        return joined, [0], [len(joined)]
    return joined, starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()


_TABLE = bytes(_LOWER)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: set where more than half of the shingle hashes have it set. No word: 0.

    ``bytes.split`` splits at exactly the six white-space characters meant here.
    """
    joined, starts, ends = _shingles(text, width)
    if not starts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "text"):
        prints = np.array([fingerprint(part.text(i)) for i in range(part.n)], np.uint64)
        yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(prints.view(np.int64))], ["id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``id`` and ``print`` (the 64 bits as a long) of every row of ``docs`` (``doc_id``, ``text``)."""
    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_print, "id long, print long")


# -- links ------------------------------------------------------------------------------


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits of every choice of ``blocks - radius`` blocks; one of them agrees for any pair in the radius."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(choice) for choice in combinations(bits, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


class Forest:
    """Union of numbered nodes by least number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link all pairs at once: hook larger roots to smaller ones until every pair agrees."""
        p = self.parent
        while True:
            x, y = p[a], p[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
            while True:
                q = p[p]
                if np.array_equal(q, p):
                    break
                p[:] = q


def compare(prints: np.ndarray, lists: np.ndarray, sides: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a forest of them) between prints of one list whose sides may meet.

    Rows are sorted by list and population count. ``sides``: 0 where all rows of a list meet,
    else 1 and 2, where only rows of different sides meet.
    """
    counts = np.bitwise_count(prints)
    order = np.lexsort((counts, lists))
    prints, lists, sides, counts = prints[order], lists[order], sides[order], counts[order]
    forest = Forest(len(prints))
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    sizes = np.diff(np.r_[starts, len(prints)])
    # short lists: all of them at once, by distance between the rows
    short = np.repeat(sizes <= 64, sizes)
    rows = np.flatnonzero(short)
    for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
        rows = rows[rows + step < len(prints)]
        rows = rows[lists[rows] == lists[rows + step]]
        if not len(rows):
            break
        near = np.bitwise_count(prints[rows] ^ prints[rows + step]) <= radius
        near &= (sides[rows] != sides[rows + step]) | (sides[rows] == 0)
        forest.join(rows[near], rows[near] + step)
    # long lists: tile by tile
    for at in np.flatnonzero(sizes > 64):
        begin, end = starts[at], starts[at] + sizes[at]
        tiles = [(t, min(t + TILE, end)) for t in range(begin, end, TILE)]
        for i, (a, b) in enumerate(tiles):
            for c, d in tiles[i:]:
                if int(counts[c]) - int(counts[b - 1]) > radius:
                    break  # the population counts of later tiles are larger still
                near = np.bitwise_count(prints[a:b, None] ^ prints[None, c:d]) <= radius
                near &= (sides[a:b, None] != sides[None, c:d]) | (sides[a:b, None] == 0)
                if a == c:
                    near = np.triu(near, 1)
                x, y = np.nonzero(near)
                forest.join(x + a, y + c)
    linked = np.flatnonzero(forest.parent != np.arange(len(prints)))
    return order[linked], order[forest.parent[linked]]


#: Rows of sorted lists that a task compares at a time.
BLOCK_ROWS = 200_000


def _compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list; a list is never divided between two comparisons."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            whole = np.concatenate(held, axis=1)
            last = np.any(whole[:2] != whole[:2, -1:], axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield from _compared(whole[:, :cut])
            held, rows = [whole[:, cut:]], whole.shape[1] - cut
    if held:
        yield from _compared(np.concatenate(held, axis=1))


def _compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = np.cumsum(np.r_[0, np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)])
    prints = np.ascontiguousarray(rows[2]).view(np.uint64)
    a, b = compare(prints, lists, rows[3])
    yield pa.RecordBatch.from_arrays([pa.array(rows[2][a]), pa.array(rows[2][b])], ["x", "y"])


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``x``, ``y`` of prints within the radius that connect all such pairs (``prints``: distinct ``print``)."""
    masks = F.array(*(F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(block_masks())))
    listed = prints.select("print", F.explode(masks).alias("m")).select(
        "print", F.col("m.choice").cast("long").alias("choice"), F.col("print").bitwiseAND(F.col("m.mask")).alias("part")
    )
    # how many share a list, by population count; the lists of one print need no comparison
    pop = F.bit_count("print").cast("int")
    cells = listed.groupBy("choice", "part", pop.alias("pop")).agg(F.count("*").alias("n"))
    lists = cells.groupBy("choice", "part").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("pop", "n"))).alias("by_pop")
    )
    lists = lists.where("total > 1").withColumnsRenamed({"choice": "c", "part": "p"})
    found = listed.join(lists, (F.col("choice") == F.col("c")) & (F.col("part") == F.col("p")))
    whole = found.where(F.col("total") <= TILE).select("choice", "part", "print", F.lit(0).cast("long").alias("side"))
    salts = lambda at: F.ceil(F.coalesce(F.col("by_pop")[at], F.lit(0)) / TILE).cast("int")
    own = F.pmod(F.xxhash64("print"), salts(pop)).cast("int")
    # a long list: every pair of cells (population count, salt) within the radius is a list of its own
    meets = F.flatten(
        F.transform(
            F.sequence(F.lit(-RADIUS), F.lit(RADIUS)),
            lambda d: F.transform(
                F.array_repeat(F.lit(0), salts(pop + d)),
                lambda _, s: F.struct((pop + d).cast("int").alias("pop"), s.cast("int").alias("salt")),
            ),
        )
    )
    here = F.struct(pop.alias("pop"), own.alias("salt"))
    split = (
        found.where(F.col("total") > TILE)
        .select("choice", "part", "print", here.alias("here"), F.explode(meets).alias("there"))
        .select(
            F.xxhash64("choice", "part", F.least("here", "there"), F.greatest("here", "there")).alias("part"),
            "print",
            F.when(F.col("here") == F.col("there"), 0).when(F.col("here") < F.col("there"), 1).otherwise(2).cast("long").alias("side"),
        )
        .select(F.lit(-1).cast("long").alias("choice"), "part", "print", "side")
    )
    lists = whole.unionAll(split).repartition("choice", "part").sortWithinPartitions("choice", "part")
    return lists.mapInArrow(_compare_sorted, "x long, y long")


def _classes(rows: DataFrame) -> DataFrame:
    """Every distinct ``print`` of ``rows`` (``id``, ``print``): its smallest id, ``least``, and its
    ``component``, named by the smallest print, which is never null."""
    classes = common.cut(rows.groupBy("print").agg(F.min("id").alias("least")))
    found = components(links(classes.select("print")).withColumnsRenamed({"x": "a", "y": "b"}))
    return classes.join(found, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``): its fingerprint and component.

    A null text has no words, and fingerprint zero as any text without words. A component is
    named by its smallest id; rows with a null id take part and are null only if all are.
    Repeated rows come out as often. Other columns are not read.
    """
    rows = common.cut(fingerprints(docs))
    named = _classes(rows)
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "k")
    named = named.join(least, F.col("component") == F.col("k")).select(F.col("print").alias("key"), "component_id")
    return rows.join(named, F.col("print") == F.col("key")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _print_beside(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "text"):
        prints = np.array([fingerprint(part.text(i)) for i in range(part.n)], np.uint64)
        yield pa.RecordBatch.from_arrays([*part.rows.columns, pa.array(prints.view(np.int64))], [*part.rows.schema.names, name])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, that of its smallest id, with all its columns.

    Ids only choose within a component: a null id comes last, and an id that stands in several
    components has a row in each of them. Rows alike in id and fingerprint are repeats, of
    which any one stays. Other columns may have any name.
    """
    key = common.free_names(docs.columns, "print", "least", "none")
    print_, least, none = key
    # of each component one pair of print and id, which are what a row is found by
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "print")).alias("first")
    keep = _classes(common.cut(fingerprints(docs))).groupBy("component").agg(first).select(
        F.col("first.print").alias(print_), F.coalesce("first.least", F.lit(0)).alias(least), F.col("first.none").alias(none)
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(print_, T.LongType())])
    number = F.col("doc_id").cast("long")
    rows = docs.mapInArrow(partial(_print_beside, print_), schema).withColumns({least: F.coalesce(number, F.lit(0)), none: number.isNull()})
    # repeats go before the shuffle, so that a long group of them meets in no task
    return rows.dropDuplicates(key).join(keep, key, "left_semi").drop(*key)
