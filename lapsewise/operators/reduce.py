"""Rows left out before a shuffle because their key cannot have a partner: a Bloom filter made of 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a filter. They bound it: 4 MB of bits, about five times that as a broadcast table.
WORDS = 1 << 19
#: Bits a key sets, all in one word, so that a key is looked up once.
BITS = 3


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("bigint"))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63)).cast("int"))
        for n in range(BITS)
    ]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def key_filter(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """The filter of all values of ``key``: at most ``words`` rows (filter_word, filter_bits), however many keys there are."""
    marks = keys.select(_word(F.col(key), words).alias("filter_word"), _mask(F.col(key)).alias("mask"))
    return marks.groupBy("filter_word").agg(F.bit_or("mask").alias("filter_bits"))


def may_have(rows: DataFrame, key: str, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """``rows`` without those whose ``key`` (of the type the filter was made from) is surely not in the filter ``keys``.

    All rows whose key is in it stay, and a few others, which the join that follows drops. The more keys a filter has,
    the more others; nothing else changes. Rows without a key go.
    """
    mask = _mask(F.col(key))
    held = F.col("filter_bits").bitwiseAND(mask) == mask
    found = rows.filter(F.col(key).isNotNull()).withColumn("filter_word", _word(F.col(key), words))
    return found.join(F.broadcast(keys), "filter_word").filter(held).drop("filter_word", "filter_bits")
