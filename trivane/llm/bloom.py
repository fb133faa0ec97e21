"""Bloom filters as one-row tables: which rows may have a partner, known before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
# Bits per key for about one wrong row in fifty, and the most bits there may be: eight megabytes.
BITS_PER_KEY = 8
MOST_BITS = 1 << 26
WORD = 64


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def bloom(keys: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A one-row table (words) with the bits of all keys, and the number of bits.

    Its size follows the number of keys up to MOST_BITS; beyond that more rows pass that need not, and none is lost.
    Null keys set no bit.
    """
    count = keys.count()
    bits = WORD
    while bits < min(MOST_BITS, count * BITS_PER_KEY):
        bits *= 2
    places = keys.filter(F.col(name).isNotNull()).select(F.explode(F.array(*_places(F.col(name), bits))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 AS int))")
    words = places.groupBy(F.floor(F.col("at") / WORD).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(bits // WORD).withColumnRenamed("id", "word").join(words, "word", "left")
    row = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(F.transform(row, lambda w: w["bits"]).alias("words")), bits


def may_hold(words: Column, bits: int, key: Column) -> Column:
    """Whether the key may be among those of the filter; never false for one that is."""
    tests = [F.getbit(F.get(words, F.floor(at / WORD).cast("int")), (at % WORD).cast("int")) == 1 for at in _places(key, bits)]
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return F.coalesce(found, F.lit(False))
