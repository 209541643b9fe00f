"""Helpers that several operators share: reading, cutting lineage, and texts as flat arrays."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, everywhere in this subpackage: space and U+0009 to U+000D.
SPACE_CODES = (9, 10, 11, 12, 13, 32)
#: Rows that pass between Spark and Python at a time.
BATCH_ROWS = 500
#: Bytes of text that a task turns into arrays at a time; one longer text makes a longer slice.
SLICE_BYTES = 2 << 20

_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever the driver runs.

    Also keeps the batches between Spark and Python small: whole texts travel in them, and
    buffers on both sides stay as large as the largest batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    target = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in sorted(os.walk(package)):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                out.write(path, os.path.join(name, os.path.relpath(path, package)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new local one only where none is named, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint in the shared folder instead of computed again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


class Scratch:
    """Tables written to the shared folder and read back; deleted at the end of a ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/table-{uuid4().hex}"
        self._paths.append(path)
        # rows may be megabytes long: few of them in a row group
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
        return self.spark.read.parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self._paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop())
            path.getFileSystem(hadoop).delete(path, True)


def same(left: Column, right: Column) -> Column:
    """Equality that holds between nulls too."""
    return left.eqNullSafe(right)


def with_facts(rows: DataFrame, facts: DataFrame, key: str, spread: Column, salts: int = 32) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each ``key``.

    A key may hold most of the rows: they are dealt over ``salts`` places by ``spread``, and
    every fact is there in all of them.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("__salt", salt).join(copies, [key, "__salt"]).drop("__salt")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, spread: Column, share: int = 1000, salts: int = 64) -> DataFrame:
    """``rows`` left joined with ``facts``, which has at most one row for each ``key``.

    A key with more than one in ``share`` of the rows is dealt over ``salts`` places by
    ``spread``. There are fewer than ``share`` such keys whatever the input, so they are
    broadcast. ``rows`` is read twice and should be cut. Rows with a null key have no fact.
    """
    salt, hot = free_names([*rows.columns, *facts.columns], "salt", "hot")
    total = rows.count()
    many = rows.groupBy(key).agg(F.count("*").alias(hot)).where(F.col(hot) * share > max(total, share * share)).select(key, F.lit(True).alias(hot))
    many = F.broadcast(many.where(F.col(key).isNotNull()))
    place = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    dealt = rows.join(many, key, "left").withColumn(salt, F.when(F.col(hot) | F.col(key).isNull(), place).otherwise(0)).drop(hot)
    copies = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(facts.join(many, key, "left").withColumn(salt, F.explode(copies)).drop(hot), [key, salt], "left").drop(salt)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names that no column has, whatever its case."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"{name}_"
        used.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Number of runs of characters other than white space (null: 0)."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.coalesce(F.regexp_count(blank, F.lit("[^ ]+")), F.lit(0)).cast("long")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text (null: empty text) modulo ``modulus``: the fixed folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


# -- texts as flat arrays ---------------------------------------------------------------


class Texts(NamedTuple):
    """Some rows of a batch with their texts end to end; null texts are empty."""

    rows: pa.RecordBatch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes end to end, and offsets; nulls become empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Consecutive rows whose texts together stay near ``limit`` bytes.

    At the end of a task freed memory goes back to the machine: workers live on between tasks.
    """
    try:
        for batch in batches:
            data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
            start, n = 0, batch.num_rows
            while start < n:
                end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
                end = min(max(end, start + 1), n)
                at = offsets[start : end + 1]
                yield Texts(batch.slice(start, end - start), data[at[0] : at[-1]], at - at[0])
                start = end
    finally:
        give_back()


def give_back() -> None:
    """Return memory that Python and Arrow have freed but still hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(marked: bytes | tuple[int, ...]) -> np.ndarray:
    """A look-up by byte: true for the bytes given."""
    found = np.zeros(256, bool)
    found[list(marked)] = True
    return found


SPACE = table(SPACE_CODES)
#: Bytes that begin a code point.
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the longest runs of true values that stay within one row."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    lengths = np.diff(offsets)
    first = offsets[:-1][lengths > 0]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][lengths > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


@cache
def _symbol_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (bytes, or code points), from one pass of prefix sums."""
    powers, inverses = _power_tables(len(values) + 1)
    symbols = _symbol_values()[values] if values.dtype == np.uint8 else mix(values.astype(np.uint64) + np.uint64(1))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(symbols * powers[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, end to end."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def packed(array: np.ndarray) -> bytes:
    """An array as bytes for a binary column."""
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def unpacked(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)
