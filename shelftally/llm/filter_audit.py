"""
Filter interaction audit over a sparse document-term matrix.

Texts become shards of a matrix in compressed sparse rows: documents by words, each value how
often the word occurs. A shard is first encoded by its own dictionary, whose words are sorted
by hash. Ranges of the hash are buckets: the words that shards hold of a bucket meet in one
place, where each gets a number, and the numbers go back to the shards in the order in which
the words were sent. So one dictionary holds for all shards, a word that every document has
travels once for each shard, and neither a document nor a word is a key that can be hot.

Row sums and counts of nonzero values decide the filters on words; the flags of the other
filters are joined to them, and counts of documents by flags give every order of filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a shard; one longer text makes a longer shard.
SHARD_BYTES = 8 << 20
#: Words of all shards that meet in a bucket, on average.
BUCKET_WORDS = 1 << 20
LEAST_BUCKETS = 64

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # percent of the words
MOST_CAPITALS = 10  # percent of the code points
SYMBOLS = b"#$%&*|"

_CAPITAL = common.table(tuple(range(65, 91)))
_SYMBOL = common.table(SYMBOLS)


# -- shards with their own dictionary ---------------------------------------------------

_DOCUMENTS = "doc_id array<long>, lang array<string>, print array<binary>, chars binary, capitals binary, symbols binary"
_LOCAL = f"{_DOCUMENTS}, rows binary, columns binary, counts binary, words binary, lengths binary, n_words long"


def _gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _sums(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True values by row."""
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = np.diff(offsets) > 0
    if filled.any():
        out[filled] = np.add.reduceat(marked, offsets[:-1][filled], dtype=np.int64)
    return out


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings of bytes from their bytes end to end."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row starts, columns and values of the matrix of some texts, and its words, sorted by hash."""
    inside = ~common.SPACE[data]
    starts, ends, rows = common.runs(inside, offsets)
    if not len(starts):
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8), pa.array([], pa.large_binary())
    encoded = _binary(data[inside], _ends(ends - starts)).dictionary_encode()
    words = encoded.dictionary
    bytes_, at = _flat(words)
    order = np.argsort(common.span_hashes(bytes_, at[:-1], at[1:]), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cells, counts = np.unique(rows * len(order) + rank[encoded.indices.to_numpy()], return_counts=True)
    begins = _ends(np.bincount(cells // len(order), minlength=len(offsets) - 1))
    return begins, (cells % len(order)).astype(np.int32), counts.astype(np.min_scalar_type(counts.max())), words.take(pa.array(order))


def _local_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(_gathered(batches, "text", SHARD_BYTES), "text", SHARD_BYTES):
        rows, columns, counts, words = term_counts(part.data, part.offsets)
        bytes_, at = _flat(words) if len(words) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        prints = [hashlib.sha256(part.data[a:b]).digest() for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
        packed = [
            common.packed(a)
            for a in (
                _sums(common.LEAD[part.data], part.offsets),
                _sums(_CAPITAL[part.data], part.offsets),
                _sums(_SYMBOL[part.data], part.offsets) > 0,
                rows,
                columns,
                counts,
            )
        ]
        lists = [pa.array([part.rows.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.rows.column(1).to_pylist()], pa.list_(pa.string()))]
        binaries = [*packed, bytes_.tobytes(), common.packed(np.diff(at).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(
            [*lists, pa.array([prints], pa.list_(pa.binary())), *(pa.array([b], pa.binary()) for b in binaries), pa.array([len(words)], pa.int64())],
            ["doc_id", "lang", "print", "chars", "capitals", "symbols", "rows", "columns", "counts", "words", "lengths", "n_words"],
        )


# -- one dictionary for all shards ------------------------------------------------------


def _deal(buckets: int):
    """The words of each shard by bucket, in the shard's order: a bucket is a range of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, lengths = np.frombuffer(words, np.uint8), common.unpacked(lengths)
                at = _ends(lengths)
                bucket = (common.span_hashes(data, at[:-1], at[1:]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(bucket)]
                spans = list(zip(first, last, strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[first].astype(np.int64)),
                        pa.array([shard] * len(spans), pa.int64()),
                        pa.array([words[at[a] : at[b]] for a, b in spans], pa.binary()),
                        pa.array([common.packed(lengths[a:b]) for a, b in spans], pa.binary()),
                    ],
                    ["bucket", "shard", "words", "lengths"],
                )

    return run


def _number(buckets: int):
    """Rows sorted by bucket and shard: the numbers of their words, equal for equal words."""

    def numbered(bucket: int, held: list[tuple]) -> pa.RecordBatch:
        lengths = [common.unpacked(ls) for _, _, _, ls in held]
        words = _binary(np.frombuffer(b"".join(w for _, _, w, _ in held), np.uint8), _ends(np.concatenate(lengths)))
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        cuts = np.cumsum([len(ls) for ls in lengths])[:-1]
        # no two buckets share a number, and numbers stay dense without a pass over the buckets
        numbers = [common.packed(c * buckets + bucket) for c in np.split(codes, cuts)]
        columns = [pa.array([s for _, s, _, _ in held], pa.int64()), pa.array([bucket] * len(held), pa.int64()), pa.array(numbers, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "bucket", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield numbered(held[0][0], held)
                    held = []
                held.append(row)
        if held:
            yield numbered(held[0][0], held)

    return run


_SHARD = f"shard long, {_DOCUMENTS}, rows binary, columns binary, counts binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and bucket, a shard's own row after its numbers: the shard by common columns."""
    numbers: list[np.ndarray] = []
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            found = batch.column(names.index("numbers"))[i].as_py()
            if found is not None:
                numbers.append(common.unpacked(found))
                continue
            row = batch.slice(i, 1)
            local = common.unpacked(row.column(names.index("columns"))[0].as_py())
            common_ = np.concatenate(numbers)[local] if numbers else np.zeros(0, np.int64)
            numbers = []
            columns = [row.column(names.index(n)) for n in ("shard", "doc_id", "lang", "print", "chars", "capitals", "symbols", "rows")]
            out = [*columns, pa.array([common.packed(common_)], pa.binary()), row.column(names.index("counts"))]
            yield pa.RecordBatch.from_arrays(out, ["shard", "doc_id", "lang", "print", "chars", "capitals", "symbols", "rows", "columns", "counts"])


def term_matrix(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Shards of the document-term matrix of ``docs`` (``doc_id``, ``lang``, ``text``).

    ``rows``, ``columns`` and ``counts`` are the arrays of compressed sparse rows (``common.unpacked``
    reads them); a column is one word in every shard. ``doc_id``, ``lang`` and ``print`` (SHA-256
    of the text) are lists by row, ``chars``, ``capitals`` and ``symbols`` arrays by row. Words
    are maximal runs without white space, case-sensitive; a null text is empty.
    """
    common.ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    shards = texts.mapInArrow(_local_shards, _LOCAL).withColumn("shard", F.monotonically_increasing_id())
    shards = scratch.table(shards)
    words = shards.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-words // BUCKET_WORDS))
    dealt = shards.select("shard", "words", "lengths").mapInArrow(_deal(buckets), "bucket long, shard long, words binary, lengths binary")
    numbers = dealt.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(_number(buckets), "shard long, bucket long, numbers binary")
    own = shards.drop("words", "lengths", "n_words").withColumn("bucket", F.lit(buckets).cast("long"))
    met = own.unionByName(numbers, allowMissingColumns=True)
    return met.repartition("shard").sortWithinPartitions("shard", "bucket").mapInArrow(_encode, _SHARD)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, from the rows of the matrix and what stands beside them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            rows, counts, chars, capitals, symbols = (
                common.unpacked(row[n].as_py()) for n in ("rows", "counts", "chars", "capitals", "symbols")
            )
            filled = np.diff(rows) > 0
            words = np.zeros(len(rows) - 1, np.int64)
            if filled.any():
                words[filled] = np.add.reduceat(counts, rows[:-1][filled], dtype=np.int64)
            facts = [words, np.diff(rows), chars, capitals, symbols]
            columns = [*(row[n].values for n in ("doc_id", "lang", "print")), *map(pa.array, facts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "print", "n_words", "n_distinct", "chars", "capitals", "symbols"])


def document_facts(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Row sums and nonzero counts of the matrix, and what the other filters need, by document."""
    facts = "doc_id long, lang string, print binary, n_words long, n_distinct long, chars long, capitals long, symbols boolean"
    return term_matrix(docs, scratch).mapInArrow(_facts, facts)


# -- the audit --------------------------------------------------------------------------


def _failures() -> Column:
    """Bit i is set where filter i fails; the last, on copies, is joined later."""
    conditions = (
        F.col("n_words") < LEAST_WORDS,
        F.col("n_distinct") * 100 < F.col("n_words") * LEAST_DISTINCT,
        F.col("capitals") * 100 > F.col("chars") * MOST_CAPITALS,
        F.col("symbols"),
    )
    return reduce(lambda a, b: a + b, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)))


def flags(docs: DataFrame, labels: DataFrame, scratch: common.Scratch) -> DataFrame:
    """``part``, ``failed`` (bits), ``good``, ``toxic`` of every document, alike ones counted in ``n``."""
    rows = document_facts(docs, scratch).select("doc_id", F.col("lang").alias("part"), "print", _failures().alias("failed"))
    rows = scratch.table(rows.groupBy("doc_id", "part", "print", "failed").agg(F.count("*").alias("n")))
    # a copy is no first of its text: texts are met by their digest, ids by their label
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.sum("n").alias("copies"))
    rows = scratch.table(common.join_hot(rows, firsts.where("copies > 1").drop("copies"), "print", F.col("doc_id")))
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    named = common.join_hot(rows, known.where("doc_id IS NOT NULL"), "doc_id", F.col("print"))
    return named.select(
        "part",
        (F.col("failed") + F.when(copy, 1 << 4).otherwise(0)).alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
        "n",
    )


def steps() -> list[tuple[str, int, int, int]]:
    """Each step of each order: the order, the step, its filter's bit, the bits of the filters before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of every order, by language (null: the empty string).

    ``docs``: ``doc_id``, ``lang``, ``text``; ``labels``: ``doc_id``, ``quality``, ``toxic``; others
    are not read. A null text is empty. Repeated rows are documents of their own; rows that
    repeat an id and text are no copies of each other. A null id is larger than all others and
    has no label; of several labels of one id any that says 1 counts. An empty table has no parts.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        cells = common.cut(flags(docs, labels, scratch).groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n")))
    step = F.array(
        *(
            F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before"))
            for order, step, bit, before in steps()
        )
    )
    # the cells are few: at most 2^5 sets of failures and three labels for each language
    each = cells.withColumn("s", F.explode(step)).select("*", "s.*")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier

    def total(condition: Column, of: Column | None = None) -> Column:
        return F.sum(F.when(condition, F.col("n") if of is None else of).otherwise(0)).cast("long")

    orders = len(steps()) // len(FILTERS)
    share = F.expr(f"n * ({orders} div greatest(bit_count(failed), 1))")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(here).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in an equal share of the orders
        total(fails, share).alias("shapley"),
    )
