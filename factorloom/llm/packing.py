"""Packing: optimal length buckets from the global histogram, token-budget batches inside each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.text import body, small_table
from factorloom.session import settle

#: Tokens of a sequence at most; longer documents go on in further pieces. Bounds the histogram.
MAX_TOKENS = 2048
#: Length buckets.
BUCKETS = 16
#: Tokens of a batch, padding included.
BATCH_TOKENS = 32_768
#: Sequences that one task numbers.
PART_ROWS = 100_000


def token_count(text: Column) -> Column:
    """Words, numbers and single marks of a text, and one end token."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")) + 1


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    best[k][j]: least padding of the j shortest distinct lengths in k buckets. Exact, over all
    places a bucket can end.
    """
    lengths = np.array(sorted(histogram), np.int64)
    n = len(lengths)
    if not n:
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.float64)
    rows, tokens = np.r_[0, counts.cumsum()], np.r_[0, (counts * lengths).cumsum()]
    best = np.r_[0.0, np.full(n, np.inf)]
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            cut[j] = cost.argmin()
            now[j] = cost[cut[j]]
        best = now
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, text: str = "text", row_id: str = "doc_id", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS,
         batch_tokens: int = BATCH_TOKENS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per batch: ``bucket``, ``batch``, ``bound``, ``doc_ids``, ``pieces``, ``lengths``,
    ``n_sequences``, ``n_tokens`` and ``n_padding``.

    Every document is in some batch with all its tokens: one longer than ``max_tokens`` is cut
    into pieces (numbered from 0), each a sequence. Every sequence of a batch is padded to its
    bucket's ``bound``, and a batch holds as many as ``batch_tokens`` allows (only the last
    of a bucket has fewer). Buckets come from the histogram of all lengths, ``max_tokens`` rows
    at most, so a driver-side dynamic program finds the bounds with the least padding.

    Rows of a bucket are ordered by a hash and numbered in parts of about ``part_rows``, so a
    bucket with most rows is no single task. Null and empty texts are one end token; null ids
    and repeated rows are sequences like others. Other columns are not read. An empty table
    gives no batch.
    """
    if batch_tokens < max_tokens:
        raise ValueError("a batch must hold the longest sequence")
    length = token_count(body(f"`{text}`"))
    sized = docs.select(F.col(f"`{row_id}`").alias("doc_id"), length.cast("int").alias("whole"))
    split = F.explode(F.sequence(F.lit(0), F.floor((F.col("whole") - 1) / max_tokens).cast("int")))
    pieces = sized.select("doc_id", "whole", split.alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(max_tokens), F.col("whole") - F.col("piece") * max_tokens).alias("length"))
    pieces = settle(pieces.withColumn("mix", F.xxhash64(F.lit("pack"), "doc_id", "piece")), "pieces")

    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_tokens rows at most
    bounds = best_bounds(histogram, buckets)
    rows, low = [], 0
    for k, bound in enumerate(bounds):
        n = sum(c for x, c in histogram.items() if low < x <= bound)
        parts = max(1, math.ceil(n / part_rows))
        rows += [{"length": x, "bucket": k, "bound": bound, "parts": parts} for x in histogram if low < x <= bound]
        low = bound
    table = small_table(docs.sparkSession, rows, "length: int, bucket: int, bound: int, parts: int")
    dealt = pieces.join(F.broadcast(table), "length").withColumn("part", F.pmod(F.shiftrightunsigned("mix", 16), F.col("parts")))
    sizes = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("mix", "doc_id", "piece", "length")) - 1
    numbered = dealt.join(sizes, ["bucket", "part"]).withColumn("place", F.col("offset") + place)
    capacity = F.floor(F.lit(batch_tokens) / F.col("bound"))
    batched = numbered.withColumn("batch", F.floor(F.col("place") / capacity))
    members = F.array_sort(F.collect_list(F.struct("place", "doc_id", "piece", "length")))  # batch_tokens entries at most
    grouped = batched.groupBy("bucket", "batch", "bound").agg(members.alias("m"))
    total = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return grouped.select(
        "bucket", "batch", "bound",
        F.col("m.doc_id").alias("doc_ids"), F.col("m.piece").alias("pieces"), F.col("m.length").alias("lengths"),
        F.size("m").alias("n_sequences"), total.alias("n_tokens"),
        (F.size("m").cast("long") * F.col("bound") - total).alias("n_padding"),
    )
