"""First-match range joins for range tables of any size."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.cross_section import ranged
from factorloom.operators.asof import asof_without_key
from factorloom.session import settle, ship_package

#: Cuts of the number line that one task sweeps at a time.
BLOCK = 1024


def sweep_block(cuts: list, starts: list[tuple], cover: int | None) -> list[int | None]:
    """Least rank of the ranges over each cut, in order; ``starts`` are (from, until, rank) in places of ``cuts``.

    ``cover`` is the least rank of the ranges that cover the whole block.
    """
    opening, heap, out = sorted(starts, reverse=True), [], []
    for place in range(len(cuts)):
        while opening and opening[-1][0] <= place:
            _, until, rank = opening.pop()
            heapq.heappush(heap, (rank, until))
        while heap and heap[0][1] <= place:
            heapq.heappop(heap)
        inside = heap[0][0] if heap else None
        out.append(min((x for x in (inside, cover) if x is not None), default=None))
    return out


def elementary_intervals(ranges: DataFrame, lo: str = "lo", hi: str = "hi", rank: str = "rank", block: int = BLOCK) -> DataFrame:
    """(start, rank): disjoint intervals over all ranges [lo, hi] of whole numbers, each with its first match.

    An interval reaches to the next start; where no range lies, its rank is null. ``rank`` is unique,
    the smallest wins. Ends are numbered in order, and blocks of ``block`` cuts are swept apart: a
    range enters the one or two blocks it ends in, and what it covers whole is split into
    power-of-two spans of blocks, of which only the least rank is kept. So work is linear (with the logarithm
    of the number of blocks), however ranges overlap. Ranges with a null or with hi < lo match nothing.
    """
    ship_package(ranges.sparkSession)
    r = ranges.where(F.col(lo) <= F.col(hi)).where(F.col(rank).isNotNull()).select(
        F.col(lo).cast("long").alias("a"), (F.col(hi).cast("long") + 1).alias("b"), F.col(rank).cast("long").alias("rank"))
    cuts = r.select(F.explode(F.array("a", "b")).alias("start")).distinct().withColumn("_g", F.lit(0))
    cuts = settle(ranged(cuts, ["_g"], [F.col("start")], F.lit(1)).select("start", F.col("_before").alias("at")), "cuts")
    placed = (r.join(cuts.select(F.col("start").alias("a"), F.col("at").alias("i")), "a")
              .join(cuts.select(F.col("start").alias("b"), F.col("at").alias("j")), "b").select("i", "j", "rank"))
    first, last = F.floor(F.col("i") / block), F.floor((F.col("j") - 1) / block)
    placed = settle(placed.withColumns({"first": first, "last": last}), "placed")
    # parts of blocks: those a range begins or ends in, whole or not
    ends = placed.select("i", "j", "rank", F.explode(F.array_distinct(F.array("first", "last"))).alias("block")).select(
        "block", F.greatest(F.col("i") - F.col("block") * block, F.lit(0)).alias("i"),
        F.least(F.col("j") - F.col("block") * block, F.lit(block)).alias("j"), "rank")
    ends = ends.groupBy("block", "i", "j").agg(F.min("rank").alias("rank"))  # a block has that many at most, whatever shares its ends
    cover = _least_cover(placed.where("last - first > 1").select((F.col("first") + 1).alias("x"), F.col("last").alias("y"), "rank"))
    members = cuts.select(F.floor(F.col("at") / block).alias("block"), (F.col("at") % block).cast("long").alias("i"),
                          F.lit(None).cast("long").alias("j"), F.col("start").alias("rank"), F.lit(0).alias("kind"))
    both = members.unionByName(ends.withColumn("kind", F.lit(1))).unionByName(
        cover.select("block", F.lit(0).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), "rank", F.lit(2).alias("kind")))

    def sweep(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["kind"] == 0].sort_values("i")
        parts = part[part["kind"] == 1]
        whole = part.loc[part["kind"] == 2, "rank"]
        ranks = sweep_block(own["i"].tolist(), list(zip(parts["i"].tolist(), parts["j"].astype("int64").tolist(), parts["rank"].tolist(), strict=True)),
                            int(whole.min()) if len(whole) else None)
        return pd.DataFrame({"start": own["rank"].to_numpy(), "rank": pd.array(ranks, "Int64")})

    return both.groupBy("block").applyInPandas(sweep, "start long, rank long")


def _least_cover(spans: DataFrame) -> DataFrame:
    """(block, rank): least rank of the spans [x, y) of blocks over each block that any covers.

    A span is the union of at most two power-of-two spans, which may overlap since only the minimum
    counts. Each round the spans of one size hand their least rank to their two halves.
    """
    top = spans.agg(F.max(F.col("y") - F.col("x"))).first()[0]
    if top is None:
        return spans.select(F.col("x").alias("block"), "rank").limit(0)
    size = F.floor(F.log2(F.col("y") - F.col("x"))).cast("int")
    power = F.expr("shiftleft(1L, size)")
    halves = spans.withColumn("size", size).select("size", "rank", F.explode(F.array_distinct(F.array(F.col("x"), F.col("y") - power))).alias("x"))
    left = settle(halves.groupBy("size", "x").agg(F.min("rank").alias("rank")), "spans")
    passed = None
    for k in range(int(top).bit_length() - 1, -1, -1):
        here = left.where(F.col("size") == k).select("x", "rank")
        if passed is not None:
            here = here.union(passed)
        here = here.groupBy("x").agg(F.min("rank").alias("rank"))
        if k:
            passed = settle(here.select(F.explode(F.array(F.col("x"), F.col("x") + (1 << (k - 1)))).alias("x"), "rank"), "halves")
    return here.select(F.col("x").alias("block"), "rank")


def first_match(rows: DataFrame, value: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi", rank: str = "rank",
                block: int = BLOCK) -> DataFrame:
    """``rows`` with the other columns of the range of the smallest ``rank`` that holds ``value``; null where none does.

    Values are whole numbers (others are cast, and match nothing if that fails). The range table is
    cut into elementary intervals first, so rows find theirs by an as-of join: no condition
    chain, no broadcast, no pairs. Null values match nothing.
    """
    cuts = elementary_intervals(ranges, lo, hi, rank, block).withColumnsRenamed({"start": "_start", "rank": "_rank"})
    labels = ranges.select(F.col(rank).cast("long").alias("_rank"), *[c for c in ranges.columns if c not in (lo, hi, rank)])
    # cuts are labelled, not rows: twice as many as ranges, whatever value most rows have
    labelled = cuts.where(F.col("_rank").isNotNull()).join(labels, "_rank").unionByName(cuts.where(F.col("_rank").isNull()), allowMissingColumns=True)
    keyed = rows.withColumn("_value", F.col(value).try_cast("long"))
    return asof_without_key(keyed, labelled.drop("_rank"), "_value", "_start").drop("_value", "_start")
