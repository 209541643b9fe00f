"""
Blocked Bloom filters as DataFrame expressions.

A filter has blocks of 512 bits: a key belongs to one block and sets one bit in each of its
eight words, so a probe is one look-up of a row and eight tests. A filter is small enough to
be sent to every task, whatever the number of keys; with more keys than it is made for it
lets more others pass, never fewer of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 8
BITS_PER_KEY = 16
#: The filter is broadcast, so it never exceeds 32 MB of words; that serves about 16 million keys.
MOST_BLOCKS = 1 << 19


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """One of the 64 bits of a word, drawn from six bits of a second hash."""
    at = F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def blocks_for(keys: int) -> int:
    """About ``BITS_PER_KEY`` bits for each key, up to the size that is broadcast."""
    return max(1, min(MOST_BLOCKS, -(-keys * BITS_PER_KEY // (64 * WORDS))))


def bloom(keys: DataFrame, key: str, blocks: int, block: str, words: list[str]) -> DataFrame:
    """The filter of a column: ``block`` and its words; blocks without a key are absent."""
    sums = [F.bit_or(_bit(F.col(key), i)).alias(w) for i, w in enumerate(words)]
    return keys.groupBy(_block(F.col(key), blocks).alias(block)).agg(*sums)


def with_passes(rows: DataFrame, key: str, keys: DataFrame, flag: str, blocks: int | None = None) -> DataFrame:
    """``rows`` with ``flag``: whether the filter of ``keys``, of which ``key`` is the column too, lets their ``key`` pass.

    Every key that is in ``keys`` passes. A null key does not. ``keys`` is counted first and should be cut.
    """
    blocks = blocks or blocks_for(keys.count())
    block, *words = common.free_names(rows.columns, "block", *(f"word{i}" for i in range(WORDS)))
    passed = F.col(key).isNotNull()
    for i, word in enumerate(words):
        passed = passed & (F.col(word).bitwiseAND(_bit(F.col(key), i)) != 0)
    filters = F.broadcast(bloom(keys.where(F.col(key).isNotNull()), key, blocks, block, words))
    found = rows.withColumn(block, _block(F.col(key), blocks)).join(filters, block, "left")
    return found.withColumn(flag, F.coalesce(passed, F.lit(False))).drop(block, *words)
