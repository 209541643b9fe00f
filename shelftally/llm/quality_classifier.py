"""
A quality classifier: logistic regression over hashed word n-grams.

It is trained with follow-the-regularised-leader updates (per-coordinate rates, L1 and L2) on
a bounded sample of labelled documents, and scores texts as sparse dot products with one
array of ``2 ** BITS`` weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The weights are one array of 2 ** BITS floats, so the model has a fixed size.
BITS = 20
#: Bound of the training sample: so many labelled documents, the first by a hash of their ids.
SAMPLE_ROWS = 10_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 0.1
#: The length of every text's vector of values.
NORM = 5.0

#: Tokens are runs of letters and digits, or of other characters.
_LETTERS = common.table(tuple(b for b in range(256) if chr(b).isascii() and chr(b).isalnum() or b >= 0x80))
_OTHERS = ~_LETTERS & ~common.SPACE


def features(part: common.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text, with values of length NORM: where they begin, places, values.

    Features are tokens and pairs of neighbouring tokens, hashed; a value grows with the
    logarithm of the count.
    """
    starts, ends, row = (np.concatenate(x) for x in zip(common.runs(_LETTERS[part.data], part.offsets), common.runs(_OTHERS[part.data], part.offsets), strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, row = starts[order], ends[order], row[order]
    token = common.span_hashes(part.data, starts, ends)
    near = np.flatnonzero(row[1:] == row[:-1])
    pair = common.mix(token[near] * np.uint64(3) + token[near + 1])
    where = np.concatenate([token, pair]) >> np.uint64(64 - BITS)
    keys = np.sort(np.concatenate([row, row[near]]).astype(np.uint64) << np.uint64(BITS) | where)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    value = 1 + np.log(np.diff(np.r_[first, len(keys)]))
    keys = keys[first]
    row = (keys >> np.uint64(BITS)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, value * value, part.n))
    begin = np.searchsorted(row, np.arange(part.n + 1))
    return begin, (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), (NORM * value / norm[row]).astype(np.float32)


class Leader:
    """Follow-the-regularised-leader for logistic loss; the last place is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "text"):
        begin, at, value = features(part)
        columns = [
            part.rows.column(0),
            part.rows.column(1),
            pa.LargeListArray.from_arrays(begin, pa.array(at.astype(np.int32))).cast(pa.list_(pa.int32())),
            pa.LargeListArray.from_arrays(begin, pa.array(value)).cast(pa.list_(pa.float32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["place", "label", "at", "value"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of the sample in one task: its size has a bound. The order is that of the hashes."""
    places, labels, rows = [], [], []
    for batch in batches:
        places += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        at, value = batch.column(2), batch.column(3)
        rows += [(np.append(at[i].values.to_numpy(), 1 << BITS), np.append(value[i].values.to_numpy(), np.float32(1))) for i in range(batch.num_rows)]
    leader = Leader(1 << BITS)
    order = sorted(range(len(rows)), key=lambda i: (places[i], labels[i], len(rows[i][0])))
    for _ in range(EPOCHS):
        for i in order:
            leader.learn(*rows[i], labels[i])
    weights = leader.weights(slice(None)).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([common.packed(weights)], pa.binary())], ["weights"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from ``docs`` (``doc_id``, ``text``) with ``labels`` (``doc_id``, ``quality`` 0 or 1).

    Labels that are null, or of an unknown or null id, are left out; an id with several
    labels is learned with each. Without labels every weight is 0.
    """
    common.ship(docs.sparkSession)
    labelled = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
    sample = labelled.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))
    sample = sample.orderBy("place", "__id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("place", "label", "text")
    found = rows.mapInArrow(_sampled_features, "place long, label int, at array<int>, value array<float>")
    return common.unpacked(found.repartition(1).mapInArrow(_fit, "weights binary").first()[0])


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id``, ``score`` of every row of ``docs``; a text without a token has the score of the bias."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in common.slices(batches, "text"):
            begin, at, value = features(part)
            row = np.repeat(np.arange(part.n), np.diff(begin))
            total = np.bincount(row, value * known[at], part.n) + known[-1]
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score of every row of ``docs`` (``doc_id``, ``text``), learned from labels outside the held-out fold.

    The fold of a document is the crc32 of its id as text modulo ``folds``; a null id counts
    as empty text. A null text is empty. Columns of any other name are not read.
    """
    known = labels.where(common.remainder("doc_id", folds) != held_out)
    found = scores(docs, train(docs, known, sample_rows))
    return found.select(
        "doc_id",
        (common.remainder("doc_id", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
