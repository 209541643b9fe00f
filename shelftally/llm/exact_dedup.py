"""
Exact duplicates by a cuckoo-filter index over digests of normalised texts.

An index is sharded by digest. A shard keeps a cuckoo filter, that is buckets of short
fingerprints, beside the same buckets of whole digests: a filter miss proves that a digest
is new, a hit is verified against the digests of its two buckets, and a full filter is
doubled and refilled from them. Digests can be inserted, deleted and looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bloom import with_passes

#: Deleted before texts are compared.
REMOVED = "\t\n\x0b\x0c\r "
SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Digest -> entry, with a cuckoo filter in front of bucketed content.

    ``entry`` is any object kept with a digest. Buckets hold ``SLOTS`` fingerprints of 16 bits;
    a digest may sit in either of two buckets, the second reached from the first by its
    fingerprint alone, so that a displaced fingerprint can move on without its digest.
    """

    def __init__(self, capacity: int = 1024):
        self._reset(capacity)

    def _reset(self, capacity: int) -> None:
        self.buckets = 1 << max(4, int(capacity / SLOTS / 0.85)).bit_length()
        self.filter = np.zeros((self.buckets, SLOTS), np.uint16)
        self.content: dict[int, dict[bytes, object]] = {}
        self.size = 0

    def _place(self, digest: bytes) -> tuple[int, int]:
        """The first bucket and the fingerprint (never 0, which marks a free slot)."""
        return int.from_bytes(digest[:8], "big") & (self.buckets - 1), int.from_bytes(digest[8:10], "big") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _maybe(self, bucket: int, mark: int) -> bool:
        row = self.filter[bucket]
        return mark in row or mark in self.filter[self._other(bucket, mark)]

    def get(self, digest: bytes):
        """The entry of a live digest, else None. Content is read only after a filter hit."""
        bucket, mark = self._place(digest)
        if not self._maybe(bucket, mark):
            return None
        return self.content.get(bucket, {}).get(digest)

    def __contains__(self, digest: bytes) -> bool:
        return self.get(digest) is not None

    def put(self, digest: bytes, entry) -> None:
        """Insert a digest, or replace the entry of a live one."""
        bucket, mark = self._place(digest)
        held = self.content.setdefault(bucket, {})
        fresh = digest not in held
        held[digest] = entry
        if fresh:
            self.size += 1
            if not self._insert(bucket, mark):
                self._grow()

    def _insert(self, bucket: int, mark: int) -> bool:
        for b in (bucket, self._other(bucket, mark)):
            free = np.flatnonzero(self.filter[b] == 0)
            if len(free):
                self.filter[b, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.filter[b, slot] = int(self.filter[b, slot]), mark
            b = self._other(b, mark)
            free = np.flatnonzero(self.filter[b] == 0)
            if len(free):
                self.filter[b, free[0]] = mark
                return True
        return False

    def _grow(self) -> None:
        """Overflow: twice the buckets, filled again from the stored digests."""
        kept = list(self.items())
        capacity = self.buckets * SLOTS
        while True:
            capacity *= 2
            self._reset(capacity)
            if all(self._refill(digest, entry) for digest, entry in kept):
                return

    def _refill(self, digest: bytes, entry) -> bool:
        bucket, mark = self._place(digest)
        self.content.setdefault(bucket, {})[digest] = entry
        self.size += 1
        return self._insert(bucket, mark)

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; one that was never inserted is left alone."""
        bucket, mark = self._place(digest)
        held = self.content.get(bucket, {})
        if digest not in held:
            return False
        del held[digest]
        if not held:
            self.content.pop(bucket)
        self.size -= 1
        for b in (bucket, self._other(bucket, mark)):
            found = np.flatnonzero(self.filter[b] == mark)
            if len(found):
                self.filter[b, found[0]] = 0
                break
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content.values():
            yield from held.items()


GROUPS = "digest binary, length long, id long, rows long"
#: A map-side index is emptied into its output at so many digests, to bound a task's memory.
FLUSH = 200_000


def _better(a: tuple, b: tuple) -> tuple:
    """The longer text, then the smaller id; a null id comes last."""
    rank = lambda e: (-e[0], e[1] is None, e[1] or 0)
    best = a if rank(a) <= rank(b) else b
    return best[0], best[1], a[2] + b[2]


def _groups(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows], pa.binary()),
            pa.array([e[0] for _, e in rows], pa.int64()),
            pa.array([e[1] for _, e in rows], pa.int64()),
            pa.array([e[2] for _, e in rows], pa.int64()),
        ],
        ["digest", "length", "id", "rows"],
    )


def _merge(limit: int | None):
    """Fold rows into an index by digest: the combine step before and after the shuffle."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, *entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = index.get(digest)
                index.put(digest, tuple(entry) if known is None else _better(known, tuple(entry)))
            if limit and index.size >= limit:
                yield _groups(index)
                index = CuckooIndex()
        yield _groups(index)

    return fold


def digests(docs: DataFrame) -> DataFrame:
    """``id``, ``length`` (code points of the whole text) and ``digest`` (SHA-256 of the text without white space)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.length(text).cast("long").alias("length"),
        F.unhex(F.sha2(F.translate(text, REMOVED, ""), 256)).alias("digest"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per live digest: the row that stays, and how many there are.

    Rows with ``digest``, ``length`` and ``id`` are folded into an index where they are read,
    so that a group of any size leaves each task as one row, and then into one index per shard.
    """
    common.ship(rows.sparkSession)
    partial = rows.select("digest", "length", "id", F.lit(1).cast("long").alias("rows"))
    partial = partial.mapInArrow(_merge(FLUSH), GROUPS)
    return partial.repartition("digest").mapInArrow(_merge(None), GROUPS)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with the row that stays of its group of equal texts.

    A null text is empty. Of equal texts the one with the most code points stays, then the one
    with the smallest id; a null id is the largest. Rows alike in id, length and text are one
    group of repeats of which the first stays. Other columns are not read.
    """
    rows = common.cut(digests(docs))
    best = groups(rows).select("digest", F.col("id").alias("keep_id"), F.col("length").alias("keep_length"), F.col("rows").alias("group_size"))
    repeats = rows.groupBy("digest", "id", "length").agg(F.count("*").alias("repeats"))
    first = common.same(F.col("id"), F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    return (
        repeats.join(best, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
        .select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            (first & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Groups are found on narrow rows. A text that equals no other stays where it is: only rows
    that a filter of the repeated digests lets pass are shuffled, once, to meet the row that
    stays of their group. A digest that many of them share is dealt over salts. Of rows alike in
    id, length and text any one stays.
    """
    digest, length, number, possible, id_, size, again = common.free_names(
        docs.columns, "digest", "length", "id", "possible", "kept_id", "kept_length", "repeats"
    )
    rows = common.cut(digests(docs))
    repeats = rows.groupBy("digest", "length", "id").agg(F.count("*").alias("repeats")).withColumnsRenamed({"digest": "d", "length": "n", "id": "i"})
    best = groups(rows).where("rows > 1").drop("rows")
    on = (F.col("digest") == F.col("d")) & (F.col("length") == F.col("n")) & common.same(F.col("id"), F.col("i"))
    kept = best.join(repeats, on).select(
        F.col("digest").alias(digest), F.col("id").alias(id_), F.col("length").alias(size), F.col("repeats").alias(again)
    )
    kept = common.cut(kept)
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumns(
        {
            number: F.col("doc_id").cast("long"),
            length: F.length(text).cast("long"),
            digest: F.unhex(F.sha2(F.translate(text, REMOVED, ""), 256)),
        }
    )
    asked = with_passes(marked, digest, kept, possible)
    shared = common.cut(asked.where(F.col(possible)))
    met = common.join_hot(shared, kept, digest, F.xxhash64(number, length))
    stays = F.col(again).isNull() | ((F.col(length) == F.col(size)) & common.same(F.col(number), F.col(id_)))
    met = met.where(stays)
    once = met.where(F.coalesce(F.col(again), F.lit(1)) == 1)
    repeated = met.where(F.col(again) > 1).dropDuplicates([digest])
    alone = asked.where(~F.col(possible))
    out = [df.select(*(F.col(f"`{c}`") for c in docs.columns)) for df in (alone, once, repeated)]
    return out[0].unionAll(out[1]).unionAll(out[2])


# -- a standing index -------------------------------------------------------------------

INDEX = "shard int, digests binary"


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """A standing index of the digests in ``rows`` (``digest``): one row per shard, to be stored as a table."""
    return update_index(None, rows.select("digest", F.lit(True).alias("live")), shards)


def update_index(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """Insert (``live`` true) and delete (false) digests. Changes of one digest must agree.

    The filter is filled from the stored digests of a shard, changed, and stored as digests again.
    """
    common.ship(changes.sparkSession)
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    changes = changes.where("digest IS NOT NULL").groupBy("digest").agg(F.max("live").alias("live")).select(shard, "digest", "live")
    if index is None:
        index = changes.sparkSession.createDataFrame([], INDEX)
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_apply, INDEX)


def _apply(key: tuple, stored: pa.Table, changes: pa.Table) -> pa.Table:
    index = load_shard(stored.column("digests")[0].as_py() if stored.num_rows else b"")
    for digest, live in zip(changes.column("digest").to_pylist(), changes.column("live").to_pylist(), strict=True):
        if live:
            index.put(digest, True)
        else:
            index.delete(digest)
    held = b"".join(sorted(d for d, _ in index.items()))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "digests": pa.array([held], pa.binary())})


def load_shard(digests: bytes, width: int = 32) -> CuckooIndex:
    index = CuckooIndex(len(digests) // width)
    for at in range(0, len(digests), width):
        index.put(digests[at : at + width], True)
    return index


def probe_index(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with a digest that is live in the index: ``digest``, once each."""
    common.ship(rows.sparkSession)
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    asked = rows.where("digest IS NOT NULL").select(shard, "digest").distinct()
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_found, "digest binary")


def _found(stored: pa.Table, asked: pa.Table) -> pa.Table:
    index = load_shard(stored.column("digests")[0].as_py() if stored.num_rows else b"")
    return pa.table({"digest": pa.array([d for d in asked.column("digest").to_pylist() if d in index], pa.binary())})
