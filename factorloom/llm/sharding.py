"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.text import fresh, small_table, without

#: Logical source partitions at most; bounds the matrix that the driver draws and broadcasts.
SOURCE_PARTS = 4096
#: Rows that one source partition or one piece of a shard should hold.
PART_ROWS = 100_000


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of ``draws`` balls taken from ``good`` + ``bad`` are good.

    Exact inversion that walks outward from the mode, about one standard deviation long.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - p_mode
    if u <= 0:
        return mode
    down, up, p_down, p_up = mode, mode, p_mode, p_mode
    while down > low or up < high:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode  # rounding left a sliver of probability


def communication_matrix(row_sums: list[int], column_sums: list[int], seed: int) -> list[list[int]]:
    """Cell (p, s): how many rows of source partition p go to shard s in a uniform shuffle."""
    rng, left, matrix = random.Random(seed), list(column_sums), []
    for n in row_sums:
        row, pool = [], sum(left)
        for s, room in enumerate(left):
            k = hypergeometric(room, pool - room, n, rng)
            row.append(k)
            pool -= room
            n -= k
            left[s] -= k
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, keys: tuple[str, ...] = ("doc_id", "text"), seed: int = 7,
                        part_rows: int = PART_ROWS, source_parts: int = SOURCE_PARTS) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0-based) and ``slot``, a gapless place in the shard.

    Shard sizes differ by one at most. ``source_parts`` is a power of two. Rows fall into
    logical source partitions by a hash of ``keys``, so a lost task computes the same rows
    again whatever the cluster's size. One count per partition goes to the driver, which
    draws the exact partition-to-shard counts. Each partition orders its rows at random and deals
    that many to each shard; each shard orders what it receives at random again. A shard is
    ordered in pieces of about ``part_rows`` rows, so no task holds a whole shard.

    The order depends on ``seed`` and the keys alone; rows with equal keys are interchangeable.
    Null keys are hashed as null, texts of any length only through their hash. Columns named
    ``shard`` or ``slot`` are replaced. An empty table gives an empty table.
    """
    df = without(df, "shard", "slot")
    first, second, part, at, cut, piece, offset = fresh(df, "first_", "second_", "part_", "at_", "cut_", "piece_", "offset_")
    columns = [F.col(f"`{k}`") for k in keys]
    mixed = df.withColumn(first, F.xxhash64(F.lit(seed), *columns)).withColumn(second, F.xxhash64(F.lit(seed + 1), F.col(first), *columns))
    fine = F.pmod(F.col(first), F.lit(source_parts))
    counts = {r[0]: r[1] for r in mixed.groupBy(fine.alias("p")).count().collect()}  # source_parts rows at most
    total = sum(counts.values())

    parts = 1
    while parts < source_parts and parts < max(64, total / part_rows):
        parts *= 2
    row_sums = [0] * parts
    for p, n in counts.items():
        row_sums[p % parts] += n
    column_sums = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(row_sums, column_sums, seed)
    cuts = [{"p": p, "c": list(accumulate(row))} for p, row in enumerate(matrix)]
    cuts = small_table(df.sparkSession, cuts, "p: bigint, c: array<bigint>").select(F.col("p").alias(part), F.col("c").alias(cut))

    pieces = max(8, math.ceil(total / shards / part_rows))
    dealt = mixed.withColumn(part, F.pmod(F.col(first), F.lit(parts)))
    dealt = dealt.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(first, second)) - 1)
    dealt = (
        dealt.join(F.broadcast(cuts), part)  # source_parts rows at most
        .withColumn("shard", F.size(F.filter(cut, lambda c: c <= F.col(at))))
        .withColumn(piece, F.pmod(F.shiftrightunsigned(second, 20), F.lit(pieces)))
        .drop(part, at, cut, first)
    )
    sizes = dealt.groupBy("shard", piece).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    place = F.row_number().over(Window.partitionBy("shard", piece).orderBy(second)) - 1
    return dealt.join(sizes, ["shard", piece]).select(
        *[F.col(f"`{c}`") for c in df.columns], "shard", (F.col(offset) + place).cast("long").alias("slot"))
