"""Bit filters of fixed size: a broadcast test for keys, whatever their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.text import fresh
from factorloom.session import settle

#: Words of 64 bits in a filter, and rows of its table at most.
WORDS = 1 << 17


def slot_of(key: Column, n_words: int = WORDS) -> Column:
    return F.pmod(key, F.lit(64 * n_words))


def _word(slot: Column) -> Column:
    return F.shiftrightunsigned(slot, 6)


def bit_filter(slots: DataFrame, at_least: int = 1) -> DataFrame:
    """(word, bits): the values of ``slot`` that ``at_least`` rows have."""
    common = slots.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return settle(common.groupBy(_word(F.col("slot")).alias("word")).agg(F.bit_or(bit).alias("bits")), "filter")


def test_filter(df: DataFrame, slot: Column, table: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: the row's slot is in the filter. True for every key that went in, and for few others
    until the filter fills up."""
    at, word, bits = fresh(df, "slot_at", "word_at", "bits_at")
    table = F.broadcast(table.select(F.col("word").alias(word), F.col("bits").alias(bits)))  # WORDS rows at most
    hit = F.coalesce(F.expr(f"getbit(`{bits}`, cast(`{at}` & 63 as int))"), F.lit(0)) == 1
    slotted = df.withColumn(at, slot)
    return slotted.join(table, _word(F.col(at)) == F.col(word), "left").withColumn(flag, hit).drop(at, word, bits)
