"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.filters import WORDS, bit_filter, slot_of, test_filter
from factorloom.llm.text import ascii_lower, body, fresh, set_aside, without

#: Rows of one large group of copies meet their group's summary in this many tasks.
SALTS = 16


def mark_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id", prefix_chars: int = 64,
                filter_words: int = WORDS, salts: int = SALTS) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical after lower-casing A-Z. Three levels, each on what the one
    before could not tell apart: the byte length, a hash of the first ``prefix_chars``
    characters, and SHA-256 of the whole text. A level leaves a bit filter of fixed size
    (slots that two or more rows share) that later levels test while scanning, so the whole
    text is normalised and hashed only for rows that share length and prefix with another.
    A full filter costs hashing, never a result: groups are formed on (length, prefix hash,
    full hash). Copies are counted before any shuffle, and rows that no filter lets through are
    alone and never shuffled.

    Of equal texts the row with the largest id stays, one row even if that id is repeated.
    Null text counts as empty; a null id is smaller than any other, and a group with only null
    ids keeps one row and has a null ``keep_id``. Columns named like the three new ones are
    replaced; others pass through. An empty table gives an empty table.
    """
    docs = without(docs, "keep_id", "group_size", "kept")
    size, head, full, salt, near1, near2 = fresh(docs, "size_", "head_", "full_", "salt_", "near1_", "near2_")
    raw = body(f"`{text}`")

    sized = docs.withColumn(size, F.octet_length(raw).cast("long"))
    by_size = slot_of(F.col(size), filter_words)
    headed = test_filter(sized, by_size, bit_filter(sized.select(by_size.alias("slot")), 2), near1)
    headed = headed.withColumn(head, F.when(F.col(near1), F.xxhash64(ascii_lower(F.substring(raw, 1, prefix_chars)))))
    by_head = slot_of(F.xxhash64(size, head), filter_words)
    hashed = test_filter(headed, by_head, bit_filter(headed.where(F.col(near1)).select(by_head.alias("slot")), 2), near2)
    near = F.col(near1) & F.col(near2)
    ident = F.col(f"`{row_id}`")
    own = [F.col(f"`{c}`") for c in docs.columns]
    alone = hashed.where(~near).select(*own, ident.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    hashed = hashed.where(near).withColumn(full, F.sha2(ascii_lower(raw), 256))
    hashed = hashed.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{row_id}`")), F.lit(salts)).cast("int"))
    hashed = hashed.drop(near1, near2)

    keys = [size, head, full]
    groups = (
        hashed.groupBy(*keys)
        .agg(F.max(F.col(f"`{row_id}`")).alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    joined = hashed.join(groups, [*keys, salt], "left")
    place = F.row_number().over(Window.partitionBy(*keys, salt, f"`{row_id}`").orderBy(F.lit(1)))
    single = F.col("group_size").isNull()
    told = joined.select(
        *own,
        F.when(single, ident).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (ident.eqNullSafe(F.col("keep_id")) & (place == 1))).alias("kept"),
    )
    return alone.union(told)


def drop_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``mark_copies`` keeps, with their own columns."""
    aside, restore = set_aside(docs, "keep_id", "group_size", "kept")
    return mark_copies(aside, text, row_id).where("kept").select(*restore)
