"""Blocked Bloom filter of a column's values, by DataFrame functions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: one for VALUES_A_WORD values, PROBES bits of one word for a value, MOST_WORDS (16 MB) at most. Of more
#: values the filter gets fuller and lets more others pass, which an exact join is to take out.
VALUES_A_WORD, PROBES, MOST_WORDS = 5, 6, 1 << 21


def _block(value: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(words)).cast("int")


def _mask(value: Column) -> Column:
    """PROBES bits of a word, from a second hash."""
    h = F.xxhash64(value, F.lit(1))
    one = F.lit(1).cast("long")
    place = lambda k: F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = [F.call_function("shiftleft", one, place(k)) for k in range(PROBES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_words(known: DataFrame, value: str, words: int) -> DataFrame:
    """One row: words, an array of that many words. Each value sets PROBES bits of the word its hash picks."""
    set_ = known.where(F.col(value).isNotNull()).groupBy(_block(F.col(value), words).alias("b")).agg(F.bit_or(_mask(F.col(value))).alias("w"))
    every = known.sparkSession.range(words).select(F.col("id").cast("int").alias("b")).join(set_, "b", "left")
    in_order = F.array_sort(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0).cast("long")).alias("w"))))
    return every.agg(F.transform(in_order, lambda x: x["w"]).alias("words"))


def may_be_in(rows: DataFrame, column: str, known: DataFrame, value: str) -> DataFrame:
    """The rows whose column may be among known's values; none that is gets lost, nulls go. The filter is the only thing
    sent to every executor, and its size is bounded."""
    words, wanted = 64, known.count() / VALUES_A_WORD
    while words < wanted and words < MOST_WORDS:
        words *= 2
    bits = F.broadcast(bloom_words(known, value, words).withColumnRenamed("words", "_words"))
    mask = _mask(F.col(column))
    return rows.join(bits).where(F.get("_words", _block(F.col(column), words)).bitwiseAND(mask) == mask).drop("_words")
