"""
Quality rules: base counts of words and repeats, and n-gram perplexity within bands by language.

The language model is modified Kneser-Ney over UTF-8 bytes (white space counts as a space), so
it has no vocabulary to cut off and an n-gram packs exactly into a long. Spark counts the
n-grams of all documents. A document is scored by the model of the other half of the corpus,
so that a text that occurs once cannot vouch for itself.

The model stays in Spark under exact keys. All that the probability of a byte needs of orders
above two lies with the two bytes before it, so model and documents are dealt to shards by
those: documents as blocks of their distinct n-grams with counts. A shard sums up log
probabilities by document, and the sums of all shards are added. Orders one and two, which
have at most 256 and 65,536 n-grams in any corpus, are sent to every shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
HALVES = 2
#: Orders whose values every shard has.
LOW = 2
#: A band reaches so many interquartile ranges beyond the quartiles of its language.
REACH = 2.5
#: A text is judged as if it had so many more bytes at the median of its language, since a
#: short text says little.
PRIOR_BYTES = 400
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = common.table(b"#*$%&|<>")

_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[list(common.SPACE_CODES)] = 32


# -- counting ---------------------------------------------------------------------------


def grams(part: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts: it with the four bytes before it as one number, and its row.

    Zero bytes stand before a text.
    """
    pad = ORDER - 1
    row = np.repeat(np.arange(part.n), np.diff(part.offsets))
    at = np.arange(len(part.data)) + pad * (row + 1)
    padded = np.zeros(len(part.data) + pad * part.n, np.uint64)
    padded[at] = _BYTE[part.data]
    key = np.zeros(len(padded) - pad if part.n else 0, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(8)) | padded[i : i + len(key)]
    return key[at - pad], row


def _tally(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    totals = np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], totals.astype(np.int64)


#: Distinct n-grams that a counting task holds before it merges or hands them on.
HELD = 1_000_000


def _sum(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _tally(*map(np.concatenate, zip(*held, strict=True)))


def _folded(tallies: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tallies added up; more than one comes out only where one would outgrow a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for tally in tallies:
        held.append(tally)
        size += len(tally[0])
        if size > HELD:
            held = [_sum(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield _sum(held)


#: Blocks are made of places with few and unlike values, which this codec gives less than a bit.
_CODEC = ("zstd", 6)


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec(*_CODEC).compress(data, asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.Codec(*_CODEC).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted tally in few bytes: differences and counts, byte place by byte place, compressed."""
    both = np.stack([np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)])
    return _squeeze(both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(_expand(data), np.uint8).reshape(2, 8, -1)
    both = np.ascontiguousarray(places.transpose(0, 2, 1)).view(np.uint64)[..., 0]
    return np.cumsum(both[0], dtype=np.uint64), both[1].astype(np.int64)


def _count(shards: int):
    """The n-grams of a task's documents, counted before the shuffle: one block for each shard."""

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in common.slices(batches, "text"):
            keys, row = grams(part)
            # a document counts towards the model of the other half
            other = 1 - part.rows.column(1).to_numpy()
            yield _tally(keys << np.uint64(1) | other[row].astype(np.uint64), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _folded(tallies(batches)):
            # n-grams that begin alike go together, which keeps their differences small
            shard = (common.mix(keys >> np.uint64(17)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            found, begin = np.unique(shard[order], return_index=True)
            blocks = [_pack(keys[at], counts[at]) for at in np.split(order, begin[1:])] if len(keys) else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their shards, added up for each shard."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, size = None, 0
    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != now and held:
                yield _counted(*_sum(held))
                held, size = [], 0
            now = shard
            held.append(_unpack(block))
            size += len(held[-1][0])
            if size > HELD:
                held = [_sum(held)]
                size = len(held[0][0]) // 2
    if held:
        yield _counted(*_sum(held))
    common.give_back()


def _counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    model = (keys & np.uint64(1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(model), pa.array((keys >> np.uint64(1)).astype(np.int64)), pa.array(counts)], ["model", "gram", "c"])


def count_grams(docs: DataFrame) -> DataFrame:
    """``model``, ``gram``, ``c`` over all of ``docs`` (``text``, ``half``).

    Tasks hand on sorted blocks of counts by shard, a fraction of the size of a row for each
    n-gram. The counts of one n-gram lie in one shard, so the last sum needs no other shuffle.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select("text", "half").mapInArrow(_count(shards), "shard int, block binary").repartition("shard").sortWithinPartitions("shard")
    return blocks.mapInArrow(_add, "model int, gram long, c long")


# -- the model --------------------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and 3 or more, from how many n-grams have counts 1 to 4.

    Where one of these is zero, as in tiny corpora, 0.5, 1 and 1.5.
    """
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3))


def _by_count(c: Column, values: tuple[float, float, float]) -> Column:
    return F.when(c == 1, values[0]).when(c == 2, values[1]).otherwise(values[2])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Values of the model: ``model``, ``kind``, ``gram``, ``value``, ``weight`` from ``count_grams``.

    ``kind`` n up to ORDER is the log probability of the last byte of an n-gram after the
    others, mixed through all lower orders; ORDER + n is the log weight that the context of
    n-grams leaves to lower orders. Lower orders count the distinct bytes seen before.
    """
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 8 * n) - 1)
        tables[n] = tables[n + 1].groupBy("model", suffix.alias("gram")).agg(F.count("*").alias("c"))
        if n <= LOW:  # 65,536 n-grams of a model at most
            tables[n] = tables[n].repartition(1)
        tables[n] = common.cut(tables[n])
    c, values, below = F.col("c"), [], None
    for n in range(1, ORDER + 1):
        how_many = tables[n].groupBy("model").agg(*(F.sum((c == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
        taken = {r["model"]: discounts([r["n1"], r["n2"], r["n3"], r["n4"]]) for r in how_many}
        less = F.lit(0.0)
        for model, three in taken.items():
            less = F.when(F.col("model") == model, _by_count(c, three)).otherwise(less)
        rows = tables[n].withColumn("less", less).withColumn("context", F.shiftright("gram", 8))
        context = rows.groupBy("model", "context").agg(F.sum("c").alias("all"), F.sum("less").alias("freed")).select(
            F.col("model").alias("m"), F.col("context").alias("h"), "all", (F.col("freed") / F.col("all")).alias("rest")
        )
        rows = rows.join(context, (F.col("model") == F.col("m")) & (F.col("context") == F.col("h"))).drop("m", "h")
        if below is None:
            lower = F.lit(1 / 256)
        else:
            rows = rows.join(
                below.select(F.col("model").alias("m"), F.col("gram").alias("g"), F.col("p").alias("lower")),
                (F.col("model") == F.col("m")) & (F.col("gram").bitwiseAND((1 << 8 * (n - 1)) - 1) == F.col("g")),
            )
            lower = F.col("lower")
        p = F.greatest(c - F.col("less"), F.lit(0.0)) / F.col("all") + F.col("rest") * lower
        below = rows.select("model", "gram", "c", p.alias("p"))
        if n == ORDER - 1:  # read by the order above and by the result; the highest order only once
            below = common.cut(below)
        values.append(below.select("model", F.lit(n).alias("kind"), "gram", F.log("p").alias("value"), F.col("c").alias("weight")))
        values.append(context.select(F.col("m").alias("model"), F.lit(ORDER + n).alias("kind"), F.col("h").alias("gram"), F.log("rest").alias("value"), F.col("all").alias("weight")))
    out = values[0]
    for more in values[1:]:
        out = out.unionAll(more)
    return out


def _keyed(values: DataFrame) -> DataFrame:
    """``model``, ``kind``, ``gram``, ``value``, and ``at``: the first three as one number."""
    return values.select("model", "kind", "gram", "value", F.shiftleft(F.col("kind").cast("long"), 56).bitwiseOR(F.shiftleft(F.col("model").cast("long"), 63)).bitwiseOR(F.col("gram")).alias("at"))


def _is_low() -> Column:
    return F.col("kind").isin(*range(1, LOW + 1), *range(ORDER + 1, ORDER + LOW + 1))


class Model:
    """Sorted keys (half, kind and n-gram), and their values."""

    def __init__(self, at: np.ndarray, value: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.at, self.value = at[order], value[order]

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.at):
            return np.zeros(len(at), bool), np.zeros(len(at))
        place = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        return self.at[place] == at, self.value[place]

    def log_probability(self, keys: np.ndarray, half: np.ndarray | int = 0) -> np.ndarray:
        """Of the last byte of each n-gram of ORDER: the longest known n-gram, after the weights that unknown ones left."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        side = np.broadcast_to(np.asarray(half).astype(np.uint64) << np.uint64(63), len(keys))
        for n in range(ORDER, 0, -1):
            gram = keys[open_] & np.uint64((1 << 8 * n) - 1)
            known, value = self.find(side[open_] | np.uint64(n << 56) | gram)
            out[open_[known]] += value[known]
            open_, gram = open_[~known], gram[~known]
            known, value = self.find(side[open_] | np.uint64(ORDER + n << 56) | gram >> np.uint64(8))
            out[open_[known]] += value[known]
        out[open_] += log(1 / 256)
        return out


def _collected(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = values.select("at", "value").toArrow()
    at, value = (rows.column(i).to_numpy() for i in range(2))
    return at.astype(np.int64).view(np.uint64), value.astype(np.float64)


def train(docs: DataFrame) -> list[Model]:
    """A model for each half of ``docs`` (``text``, ``half``), counted over the other documents, whole in memory.

    For small corpora; ``score`` does not collect the model.
    """
    at, value = _collected(_keyed(kneser_ney(common.cut(count_grams(docs)))))
    half = at >> np.uint64(63)
    return [Model(at[half == h] & np.uint64((1 << 63) - 1), value[half == h]) for h in range(HALVES)]


# -- scoring ----------------------------------------------------------------------------

SCORES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, n_bytes long, log_probability double"
)


def log_probabilities(part: common.Texts, half: np.ndarray, models: list[Model]) -> np.ndarray:
    """The log probability of each text. Equal n-grams of a slice are looked up once."""
    keys, row = grams(part)
    total = np.zeros(part.n)
    for h, model in enumerate(models):
        mine = half[row] == h
        both = np.sort(keys[mine] << np.uint64(24) | row[mine].astype(np.uint64))
        key = both >> np.uint64(24)
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        value = model.log_probability(key[fresh])[np.cumsum(fresh) - 1]
        total += np.bincount((both & np.uint64((1 << 24) - 1)).astype(np.int64), value, part.n)
    return total


def base_counts(part: common.Texts) -> dict[str, np.ndarray]:
    """Counts of each text, as the columns of ``SCORES`` name them."""
    data, offsets, n = part.data, part.offsets, part.n
    solid = ~common.SPACE[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])

    starts, ends, row = common.runs(solid, offsets)
    word = common.span_hashes(data, starts, ends)
    # repeated windows, and the words that they cover
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        whole = np.flatnonzero(row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :])
        window = np.zeros(len(whole), np.uint64)
        for k in range(WINDOW):
            window = common.mix(window * np.uint64(31) + word[whole + k])
        twice = _in_groups(row[whole], window)[0]
        np.add.at(covered, whole[twice], 1)
        np.add.at(covered, whole[twice] + WINDOW, -1)
    repeated = np.cumsum(covered)[: len(word)] > 0
    # lines with a word that equal an earlier one
    begins, stops, line_row = common.runs(data != 10, offsets)
    solid_before = np.r_[0, np.cumsum(solid, dtype=np.int64)]
    filled = solid_before[stops] > solid_before[begins]
    begins, stops, line_row = begins[filled], stops[filled], line_row[filled]
    later = _in_groups(line_row, common.span_hashes(data, begins, stops))[1]
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_text(solid & common.LEAD[data]),
        "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_row[later], minlength=n),
        "n_repeat_words": np.bincount(row[repeated], minlength=n),
    }


def _in_groups(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur twice or more in their row, and which of them come after an equal one."""
    order = np.lexsort((value, row))
    equal = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    twice, later = np.zeros(len(row), bool), np.zeros(len(row), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    later[order[1:][equal]] = True
    return twice, later


# A pair of n-gram and document is one number: the two bytes that name the shard, mixed, the
# other bytes, the half, and the number of the row in its chunk.
ROW_BITS = 23
_MIX = 40503
_UNMIX = pow(_MIX, -1, 1 << 16)
#: Bytes of text whose pairs a task packs at a time; one longer text makes a longer chunk.
CHUNK_BYTES = 4 << 20
#: Log probabilities are added as whole numbers of this part, so that sums do not depend on their order.
UNIT = 2.0**-24


def _pairs(keys: np.ndarray, half: np.ndarray, row: np.ndarray) -> np.ndarray:
    two = ((keys >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(_MIX)) & np.uint64(0xFFFF)
    rest = (keys >> np.uint64(24) << np.uint64(8)) | (keys & np.uint64(0xFF))
    gram = (two << np.uint64(24) | rest) << np.uint64(1) | half.astype(np.uint64)
    return gram << np.uint64(ROW_BITS) | row.astype(np.uint64)


def _grams_of(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and halves that ``_pairs`` made numbers of."""
    gram = mixed >> np.uint64(1)
    two = ((gram >> np.uint64(24)) * np.uint64(_UNMIX)) & np.uint64(0xFFFF)
    keys = (gram >> np.uint64(8) & np.uint64(0xFFFF)) << np.uint64(24) | two << np.uint64(8) | gram & np.uint64(0xFF)
    return keys, mixed & np.uint64(1)


def _shard_of(two: Column, shards: int) -> Column:
    return F.shiftright((two * _MIX).bitwiseAND(0xFFFF) * shards, 16).cast("int")


def _shards(spark) -> int:
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)


def _pack_all(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of 0 or more, byte place by byte place, without empty places."""
    parts = []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        places = np.ascontiguousarray(a, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]
        parts.append(len(a).to_bytes(8, "little") + bytes([width]) + places.T.tobytes())
    return _squeeze(b"".join(parts))


def _unpack_all(data: bytes) -> list[np.ndarray]:
    data, at, out = _expand(data), 0, []
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
        places = np.zeros((n, 8), np.uint8)
        places[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(places.view(np.uint64).ravel())
        at += 9 + n * width
    return out


def _blocks_of(pairs: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Shards and their blocks: distinct n-grams, in how many rows each is, those rows, and counts in them.

    Of the rows of an n-gram each is kept by its distance from the one before: most pairs
    belong to n-grams of many rows, whose distances are short where rows alike lie together.
    """
    if not len(pairs):
        return
    pairs.sort()
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    counts = np.diff(np.r_[first, len(pairs)])
    pairs = pairs[first]
    shard = ((pairs >> np.uint64(ROW_BITS + 25)) * np.uint64(shards)) >> np.uint64(16)
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(edges, np.r_[edges[1:], len(pairs)], strict=True):
        gram = pairs[a:b] >> np.uint64(ROW_BITS)
        begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        rows = pairs[a:b] & np.uint64((1 << ROW_BITS) - 1)
        steps = np.diff(rows, prepend=np.uint64(0))
        steps[begin] = rows[begin]
        yield int(shard[a]), _pack_all(np.diff(gram[begin], prepend=np.uint64(0)), np.diff(np.r_[begin, b - a]), steps, counts[a:b])


def _alike(facts: pa.Table, half: np.ndarray) -> np.ndarray:
    """
    An order of a chunk's rows in which the rows of an n-gram lie close: an n-gram is of one
    half, mostly of one language, and a long text has more of them than a short one.
    """
    lang = facts.column("lang").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.lexsort((-facts.column("n_bytes").to_numpy(), lang, half))


#: ``side`` orders the rows of a shard: values of the model, facts of chunks, blocks of pairs.
_DEALT = "shard int, side int, at long, value double, block binary"
_VALUE, _FACTS, _PAIRS = range(3)


def _deal(shards: int):
    """Documents as blocks by shard; their ids, languages and base counts as one more block of each chunk (``at``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        facts: list[pa.RecordBatch] = []
        halves: list[np.ndarray] = []
        rows, size, chunk = 0, 0, place << 32

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(facts).combine_chunks()
            order = _alike(table, np.concatenate(halves))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table.take(pa.array(order)))
            number = np.empty(rows, np.uint64)
            number[order] = np.arange(rows, dtype=np.uint64)
            for pairs in held:
                pairs[:] = (pairs >> np.uint64(ROW_BITS) << np.uint64(ROW_BITS)) | number[(pairs & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)]
            made = [(chunk % shards, _FACTS, _squeeze(out.getvalue().to_pybytes()))]
            made += [(shard, _PAIRS, block) for shard, block in _blocks_of(np.concatenate(held), shards)]
            shard, side, block = zip(*made, strict=True)
            columns = [pa.array(shard, pa.int32()), pa.array(side, pa.int32()), pa.array([chunk] * len(made), pa.int64()), pa.nulls(len(made), pa.float64()), pa.array(block, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _DEALT.split(", ")])

        for part in common.slices(batches, "text"):
            if rows and (size + len(part.data) > CHUNK_BYTES or rows + part.n > 1 << ROW_BITS):
                yield whole()
                held, facts, halves, rows, size, chunk = [], [], [], 0, 0, chunk + 1
            keys, row = grams(part)
            halves.append(part.rows.column(3).to_numpy())
            held.append(_pairs(keys, halves[-1][row], row + rows))
            columns = [part.rows.column(0), part.rows.column(2), *(pa.array(v, pa.int64()) for v in base_counts(part).values())]
            columns.append(pa.array(np.diff(part.offsets), pa.int64()))
            facts.append(pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")[:-1]]))
            rows, size = rows + part.n, size + len(part.data)
        if rows:
            yield whole()

    return run


_SUMMED = "chunk long, side int, block binary"


def _sum_shards(low):
    """Rows by shard and side: the sums of each chunk's documents in the shard; facts go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low_at, low_value = low.value
        at, value, now, model = [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, side, number, worth, block = batch.columns
            shard, side = shard.to_numpy(), side.to_numpy()
            edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (side[1:] != side[:-1])])
            made: list[tuple[int, int, bytes]] = []
            for a, b in zip(edges, np.r_[edges[1:], len(shard)], strict=True):
                if shard[a] != now:
                    at, value, now, model = [low_at], [low_value], shard[a], None
                if side[a] == _VALUE:
                    at.append(number.slice(a, b - a).to_numpy().view(np.uint64))
                    value.append(worth.slice(a, b - a).to_numpy())
                elif side[a] == _FACTS:
                    made += [(number[i].as_py(), _FACTS, block[i].as_py()) for i in range(a, b)]
                else:
                    if model is None:
                        model = Model(np.concatenate(at), np.concatenate(value))
                        at, value = [], []
                    made += [(number[i].as_py(), _PAIRS, _summed(model, block[i].as_py())) for i in range(a, b)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in _SUMMED.split(", ")])
        common.give_back()

    return run


def _summed(model: Model, block: bytes) -> bytes:
    gram, spread, steps, counts = _unpack_all(block)
    first = np.cumsum(spread) - spread
    so_far = np.cumsum(steps)
    rows = so_far - np.repeat((so_far - steps)[first.astype(np.int64)], spread.astype(np.int64))
    units = np.rint(model.log_probability(*_grams_of(np.cumsum(gram, dtype=np.uint64))) / UNIT).astype(np.int64)
    sums = np.zeros(int(rows.max(initial=0)) + 1, np.int64)
    np.add.at(sums, rows.astype(np.int64), np.repeat(units, spread.astype(np.int64)) * counts.astype(np.int64))
    met = np.flatnonzero(sums)
    # logarithms of probabilities are 0 or less
    return _pack_all(np.diff(met, prepend=0), -sums[met])


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk and side: facts of its documents with the sums of all shards."""
    facts, sums, now = None, None, None

    def whole() -> pa.RecordBatch:
        columns = [*facts.columns, pa.array(sums * UNIT)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")])

    for batch in batches:
        for chunk, side, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk != now:
                if facts is not None:
                    yield whole()
                facts, now = None, chunk
            if side == _FACTS:
                table = pa.ipc.open_stream(_expand(block)).read_all().combine_chunks()
                facts = table.to_batches()[0]
                sums = np.zeros(facts.num_rows, np.int64)
            else:
                step, less = _unpack_all(block)
                sums[np.cumsum(step).astype(np.int64)] -= less.astype(np.int64)
    if facts is not None:
        yield whole()


def score(docs: DataFrame, values: DataFrame) -> DataFrame:
    """Base counts and log probability of every row of ``docs`` (``doc_id``, ``text``, ``lang``, ``half``) by ``kneser_ney``'s values.

    A partition of ``docs`` that is computed again has to give its rows in the same order.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shards = _shards(spark)
    keyed = _keyed(values)
    low = spark.sparkContext.broadcast(_collected(keyed.where(_is_low())))
    # the two bytes before the last: of an n-gram, or the end of a context
    two = F.when(F.col("kind") > ORDER, F.col("gram")).otherwise(F.shiftright("gram", 8)).bitwiseAND(0xFFFF)
    model = keyed.where(~_is_low()).select(_shard_of(two, shards).alias("shard"), F.lit(_VALUE).alias("side"), "at", "value", F.lit(None).cast("binary").alias("block"))
    dealt = docs.select("doc_id", "text", "lang", "half").mapInArrow(_deal(shards), _DEALT)
    by_shard = model.unionAll(dealt).repartition("shard").sortWithinPartitions("shard", "side")
    sums = by_shard.mapInArrow(_sum_shards(low), _SUMMED)
    return sums.repartition("chunk").sortWithinPartitions("chunk", "side").mapInArrow(_sum_chunks, SCORES)


#: Quantiles are taken over bins of this width, so that they do not depend on the order of rows.
BIN = 1e-4


def _bin(value: Column) -> Column:
    return F.round(value / BIN).cast("long")


def _quantiles(rows: DataFrame, value: Column, *shares: float) -> DataFrame:
    """``of`` (a language) and ``q``, an array: for each share the least bin that so many of its values reach.

    Values are logarithms of perplexities, so a language has some tens of thousands of bins.
    """
    bins = rows.where(value.isNotNull()).groupBy(F.col("lang").alias("of"), _bin(value).alias("bin")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.withColumns({"below": F.sum("n").over(so_far), "all": F.sum("n").over(Window.partitionBy("of"))})
    reached = [F.min(F.when(F.col("below") >= F.col("all") * s, F.col("bin"))) * BIN for s in shares]
    return placed.groupBy("of").agg(F.array(*reached).alias("q"))


def quality(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (``doc_id``, ``text``, ``lang``; others are not read).

    A null text is empty, and fails for its lack of words. The perplexity of a text is that of
    its bytes with ``PRIOR_BYTES`` at the median of its language; a language's band lies between its lower quartile less ``reach`` interquartile
    ranges and its upper quartile plus as much, in logarithms, over all its documents. Null is
    a language of its own. Rows with equal ids are judged each by itself.
    """
    half = F.pmod(F.xxhash64("doc_id"), F.lit(HALVES)).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), half.alias("half"))
    rows = common.cut(score(docs, kneser_ney(common.cut(count_grams(docs)))))
    loss = -F.col("log_probability")
    middle = _quantiles(rows, F.when(F.col("n_bytes") > 0, loss / F.col("n_bytes")), 0.5).select(F.col("of").alias("middle_lang"), F.col("q")[0].alias("middle"))
    rows = rows.join(middle, common.same(F.col("lang"), F.col("middle_lang")), "left").drop("middle_lang")
    shrunk = (loss + PRIOR_BYTES * F.col("middle")) / (F.col("n_bytes") + PRIOR_BYTES)
    rows = rows.withColumn("log_perplexity", F.when(F.col("n_bytes") > 0, shrunk))
    bands = _quantiles(rows, F.col("log_perplexity"), 0.25, 0.75).select(
        F.col("of").alias("band_lang"),
        (F.col("q")[0] - reach * (F.col("q")[1] - F.col("q")[0])).alias("lowest"),
        (F.col("q")[1] + reach * (F.col("q")[1] - F.col("q")[0])).alias("highest"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    # a text is judged by its bin, as the quartiles are: a band may be one bin
    inside = (_bin(F.col("log_perplexity")) * BIN).between(F.col("lowest"), F.col("highest"))
    return rows.join(bands, common.same(F.col("lang"), F.col("band_lang")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
        "lang",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp("lowest").alias("lowest"),
        F.exp("highest").alias("highest"),
    )
