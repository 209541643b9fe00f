"""
Language identification by a convolutional network over bytes.

Filters of several widths over one-hot bytes, rectified, the maximum over a window, and a
softmax over languages, all in numpy. It is trained on windows of a bounded sample of
labelled documents. A text is cut into windows of fixed length, whole, and its languages are
ranked by the mean log probability of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bytes of a window; windows overlap so that no filter position of a text is lost.
LENGTH = 128
STEP = LENGTH - max(WIDTHS) + 1
#: Bounds of the training sample: documents of each language and of all, first by a hash of
#: their ids, and windows of each, evenly spread over it.
SAMPLE_PER_LANGUAGE = 1_500
SAMPLE_ROWS = 12_000
SAMPLE_WINDOWS = 4
EPOCHS = 6
BATCH = 256
RATE = 0.01
#: Windows scored at a time.
BLOCK = 1_024
UNKNOWN = "und"
SEED = 4


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of each text begins, and its text. The last one may reach beyond its text."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - LENGTH + STEP) // STEP))
    counts[sizes == 0] = 0
    row = np.repeat(np.arange(len(sizes)), counts)
    return offsets[row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)), row


def cut_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of windows, with zeros beyond the ends of their texts."""
    at = starts[:, None] + np.arange(LENGTH)
    found = data[np.minimum(at, max(len(data) - 1, 0))]
    found[at >= ends[:, None]] = 0
    return found


class Network:
    """``filters[w][k]``: a row of filter values for each byte at place k of width w."""

    def __init__(self, languages: list[str], filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray):
        self.languages, self.filters, self.bias, self.out, self.out_bias = languages, filters, bias, out, out_bias

    @classmethod
    def new(cls, languages: list[str]) -> Network:
        rng = np.random.default_rng(SEED)
        filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(languages, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter over each window, and where it is."""
        most, where = [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            n = LENGTH - max(WIDTHS) + 1
            out = table[0][block[:, :n]]
            for k in range(1, w):
                out += table[k][block[:, k : k + n]]
            where.append(out.argmax(axis=1))
            most.append(np.take_along_axis(out, where[-1][:, None], 1)[:, 0])
        return np.concatenate(most, axis=1), np.concatenate(where, axis=1)

    def log_softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def gradients(self, block: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        pooled, where = self.pooled(block)
        hidden = np.maximum(pooled + self.bias, 0)
        error = np.exp(self.log_softmax(pooled))
        error[np.arange(len(label)), label] -= 1
        error /= len(label)
        back = (error @ self.out.T) * (hidden > 0)
        grads, lines = [], np.arange(len(block))[:, None]
        for i, w in enumerate(WIDTHS):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            grad = np.zeros_like(self.filters[i])
            for k in range(w):  # only the byte under a maximum moves
                np.add.at(grad[k], (block[lines, where[:, own] + k], np.arange(FILTERS)), back[:, own])
            grads.append(grad)
        return [*grads, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def fit(self, block: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Network:
        """Adam over batches in a fixed random order."""
        rng = np.random.default_rng(SEED)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(block))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                step += 1
                for p, g, m, v in zip(self.parameters(), self.gradients(block[chosen], label[chosen]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def compiled(self) -> Compiled:
        return Compiled(self)


class Compiled:
    """A network over pairs of bytes: all filters at a place are the sum of two table rows."""

    def __init__(self, network: Network):
        two, three, four = network.filters
        self.network = network
        pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, FILTERS)
        self.front = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        self.back = np.concatenate([pair(three[2], np.zeros_like(three[2])), pair(four[2], four[3])], axis=1)

    def log_probabilities(self, block: np.ndarray) -> np.ndarray:
        pairs = block[:, :-1].astype(np.int64) << 8 | block[:, 1:]
        n = STEP
        out = self.front[pairs[:, :n]]
        out[:, :, FILTERS:] += self.back[pairs[:, 2 : n + 2]]
        return self.network.log_softmax(out.max(axis=1))


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "text"):
        starts, row = windows(part.data, part.offsets)
        counts = np.bincount(row, minlength=part.n)
        begin = np.cumsum(counts) - counts
        spread = np.minimum(counts[:, None] - 1, (np.arange(SAMPLE_WINDOWS) * counts[:, None]) // SAMPLE_WINDOWS)
        filled = np.flatnonzero(counts)
        chosen = np.unique((begin[:, None] + spread)[filled])
        block = cut_windows(part.data, starts[chosen], part.offsets[1:][row[chosen]])
        columns = [part.rows.column(i).take(pa.array(row[chosen])) for i in (0, 1)]
        columns.append(pa.array([b.tobytes() for b in block], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["place", "label", "window"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the sample in one task: their number has a bound."""
    rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    languages = sorted({label for _, label, _ in rows})
    network = Network.new(languages)
    if len(languages) > 1:
        block = np.frombuffer(b"".join(w for *_, w in rows), np.uint8).reshape(-1, LENGTH)
        network.fit(block, np.array([languages.index(label) for _, label, _ in rows]))
    values = [pa.array([[common.packed(p) for p in network.parameters()]], pa.list_(pa.binary()))]
    yield pa.RecordBatch.from_arrays([pa.array([languages], pa.list_(pa.string())), *values], ["languages", "values"])


def train(docs: DataFrame) -> Network:
    """A network for the languages of ``docs`` (``doc_id``, ``text``, ``lang``); null ids, texts or languages are left out."""
    common.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = known.select(F.col("doc_id").alias("__id"), F.col("lang").cast("string").alias("label"), F.xxhash64("doc_id").alias("place"))
    # a language may hold most documents: all but about twice its share go by hash before they are ranked
    held = ids.groupBy("label").agg(F.count("*").alias("held"))
    even = F.pmod("place", F.lit(1 << 52)) / float(1 << 52)
    few = common.with_facts(ids, held, "label", F.col("place")).where(even * F.col("held") < 2 * SAMPLE_PER_LANGUAGE + 100)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place", "__id"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_LANGUAGE).orderBy("rank", "place", "__id", "label").limit(SAMPLE_ROWS)
    sample = sample.drop("held")
    rows = docs.join(F.broadcast(sample), (F.col("doc_id") == F.col("__id")) & (F.col("lang").cast("string") == F.col("label")))
    found = rows.select("place", "label", "text").mapInArrow(_training_windows, "place long, label string, window binary")
    row = found.repartition(1).mapInArrow(_fit, "languages array<string>, values array<binary>").first()
    *filters, bias, out, out_bias = map(common.unpacked, row["values"])
    return Network(row["languages"], filters, bias, out, out_bias)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(network: Compiled, part: common.Texts) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text: the most likely by mean log probability over all its windows."""
    names = network.network.languages
    starts, row = windows(part.data, part.offsets)
    total = np.zeros((part.n, max(1, len(names))))
    ends = part.offsets[1:]
    for at in range(0, len(starts) if names else 0, BLOCK):
        here = slice(at, at + BLOCK)
        block = cut_windows(part.data, starts[here], ends[row[here]])
        found = network.log_probabilities(block).astype(np.float64)
        for k in range(len(names)):
            total[:, k] += np.bincount(row[here], found[:, k], part.n)
    mean = total / np.maximum(1, np.bincount(row, minlength=part.n))[:, None]
    mean = np.exp(mean - mean.max(axis=1, keepdims=True))
    mean /= mean.sum(axis=1, keepdims=True)
    plain = np.diff(np.r_[0, np.cumsum(_ASCII_LETTERS[part.data])][part.offsets]) > 0
    best, score = mean.argmax(axis=1), mean.max(axis=1)
    lettered = [bool(p) or has_letter(part.text(i)) for i, p in enumerate(plain)]
    return [names[b] if ok and names else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score if names else 0.0, 0.0)


_ASCII_LETTERS = common.table(tuple(range(65, 91)) + tuple(range(97, 123)))


def with_language(docs: DataFrame, network: Network, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, in one pass over whole texts.

    A null text, or one without a letter, is ``und`` with score 0, as is any text where
    nothing was learned. The names of the new columns must not be taken.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(network)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.compiled()
        for part in common.slices(batches, "text"):
            found, sure = predict(known, part)
            columns = [*part.rows.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*part.rows.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Language of every row of ``docs`` (``doc_id``, ``text``, ``lang``), learned outside the held-out fold.

    The fold of a document is the crc32 of its id as text modulo ``folds``; a null id counts
    as empty text. Other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang")
    network = train(docs.where(common.remainder("doc_id", folds) != held_out))
    return with_language(docs.select("doc_id", "text"), network).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (common.remainder("doc_id", folds) == held_out).alias("held_out"),
        "lang_pred",
        "score",
    )
