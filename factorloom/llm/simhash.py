"""SimHash near-duplicates: a Gray-ordered hierarchical index over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.components import connected_components
from factorloom.llm.filters import bit_filter, slot_of, test_filter
from factorloom.llm.text import fresh, ready_for_python, set_aside, without
from factorloom.session import settle

#: Fingerprints that differ in this many bits at most are linked.
MAX_BITS = 2
#: Bit blocks; two codes within MAX_BITS agree on at least BLOCKS - MAX_BITS of them.
BLOCKS = 4
#: An index root with more codes than this is linked by shared one-bit variants instead.
ROOT_CODES = 1024
#: Rows that one search of a partition's roots covers.
SEARCH_ROWS = 1 << 15
#: Children of an index node.
FANOUT = 8
#: Rows of one fingerprint meet their group's row in this many tasks.
SALTS = 16


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of all runs of ``width`` words; fewer words are one run, and no words have none.

    A-Z are lower-cased; ``bytes.split`` cuts at exactly the six ASCII white spaces.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    line, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(found) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(begins, ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(begins))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, as a signed number."""
    hashes = shingle_hashes(text, width, seed)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a long column ``name``; null and empty texts have 0."""
    docs = without(docs, name)
    ready_for_python(docs.sparkSession)

    @F.arrow_udf("long")
    def computed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())

    return docs.withColumn(name, computed(F.col(f"`{text}`")))


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray sequence, shifted so that signed order is the sequence's."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks() -> list[int]:
    """Masks over BLOCKS - MAX_BITS of the bit blocks, as signed numbers: the index's roots."""
    size = 64 // BLOCKS
    one = [((1 << size) - 1) << (size * i) for i in range(BLOCKS)]
    masks = [sum(c) for c in combinations(one, BLOCKS - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_pairs(codes: np.ndarray, runs: np.ndarray, max_bits: int = MAX_BITS, budget: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of codes in one run that differ in ``max_bits`` bits at most.

    ``codes`` are uint64, in Gray order inside each run; ``runs`` numbers the runs, ascending.
    Each level of the tree groups FANOUT neighbours and keeps the bits they all share (mask and
    pattern). A search starts at its run's root, adds to its differences those on the bits
    that a child shares beyond its parent, and leaves out a whole child once they exceed
    ``max_bits``.
    """
    n = len(codes)
    levels = [(codes, np.full(n, ~np.uint64(0)), np.arange(n), np.arange(n) + 1, runs)]
    while True:
        pattern, mask, _, _, run = levels[-1]
        new_run = np.r_[True, run[1:] != run[:-1]]
        if new_run.all():
            break
        begin = np.flatnonzero(new_run)
        place = np.arange(len(run)) - np.repeat(begin, np.diff(np.r_[begin, len(run)]))
        first = np.flatnonzero(place % FANOUT == 0)
        every, some = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
        shared = ~(every ^ some) & np.bitwise_and.reduceat(mask, first)
        levels.append((every & shared, shared, first, np.r_[first[1:], len(run)], run[first]))
    ends = [levels[0][3]]  # the last code below each node, by level
    for _, _, _, until, _ in levels[1:]:
        ends.append(ends[-1][until - 1])

    root_of = np.searchsorted(levels[-1][4], runs)
    cost = np.bincount(root_of)[root_of].cumsum()
    out, low = [], 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + budget, "right")))
        query = np.arange(low, high)
        node, level = root_of[query], len(levels) - 1
        pattern, mask = levels[level][:2]
        bits = np.bitwise_count((codes[query] ^ pattern[node]) & mask[node]).astype(np.int64)
        while level:
            keep = (bits <= max_bits) & (ends[level][node] > query + 1)
            query, node, bits = query[keep], node[keep], bits[keep]
            first, until = levels[level][2][node], levels[level][3][node]
            many = until - first
            child = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            query, parent, bits = np.repeat(query, many), np.repeat(node, many), np.repeat(bits, many)
            pattern, mask = levels[level - 1][:2]
            fresh_bits = mask[child] & ~levels[level][1][parent]
            bits = bits + np.bitwise_count((codes[query] ^ pattern[child]) & fresh_bits)
            node, level = child, level - 1
        keep = (bits <= max_bits) & (node > query)
        out.append((query[keep], node[keep]))
        low = high
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, int), np.zeros(0, int))


def _smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item it is connected with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _search_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges inside the roots of a partition that is sorted by root and Gray rank."""

    def edges(table: pa.Table) -> pa.RecordBatch:
        root = table["root"].to_numpy()
        head, code = table["head"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        new = np.r_[True, (root[1:] != root[:-1]) | (head[1:] != head[:-1])]
        runs = np.cumsum(new)
        shared = np.bincount(runs)[runs] > 1
        code, runs = code[shared], runs[shared]
        if not len(code):
            return pa.record_batch({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        label = _smallest_linked(len(code), *linked_pairs(code, runs))
        moved, signed = label != np.arange(len(code)), code.view(np.int64)
        return pa.record_batch({"u": signed[moved], "v": signed[label[moved]]})

    def gathered() -> Iterator[pa.Table]:
        """Batches put together, so that a search covers many roots."""
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some.append(batch)
            if sum(b.num_rows for b in some) >= SEARCH_ROWS:
                yield pa.Table.from_batches(some)
                some = []
        if some:
            yield pa.Table.from_batches(some)

    held: pa.Table | None = None
    for table in gathered():
        table = pa.concat_tables([held, table]) if held is not None else table
        root, head = table["root"].to_numpy(), table["head"].to_numpy()
        # the last root may go on in the next batch; it has ROOT_CODES codes at most
        cut = np.flatnonzero((root != root[-1]) | (head != head[-1])) if len(root) else []
        cut = int(cut[-1]) + 1 if len(cut) else 0
        held = table.slice(cut).combine_chunks()
        if cut:
            yield edges(table.slice(0, cut).combine_chunks())
    if held is not None and len(held):
        yield edges(held)


def link_codes(codes: DataFrame, root_codes: int = ROOT_CODES) -> DataFrame:
    """Edges (u, v) over distinct codes (``fp``) that join all codes within MAX_BITS of each other.

    Every pair within MAX_BITS is connected by the edges, though not each has its own edge. A
    code goes to one root for each choice of equal blocks, so all pairs meet in some root and
    a root's rows are few. A root is searched with ``linked_pairs``. Codes of a larger root are
    instead keyed by themselves and their one-bit variants on the bits the root leaves free:
    codes two bits apart share a variant, and a key has no more codes than bits, so a root of
    any size costs a fixed number of rows per code and no task holds it whole.
    """
    ready_for_python(codes.sparkSession)
    masks = block_masks()
    roots = F.explode(F.array(*[F.struct(F.lit(i).alias("root"), F.col("fp").bitwiseAND(F.lit(m)).alias("head")) for i, m in enumerate(masks)]))
    routed = codes.select("fp", roots.alias("r")).select("r.root", "r.head", "fp")
    sizes = routed.groupBy("root", "head").agg(F.count("*").alias("n"))
    large = settle(sizes.where(F.col("n") > root_codes).select("root", "head"), "roots")

    small = routed.join(large, ["root", "head"], "left_anti").repartition("root", "head")
    searched = small.sortWithinPartitions("root", "head", gray_rank(F.col("fp"))).mapInArrow(_search_runs, "u long, v long")

    free = F.array(*[F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64) if not (m >> b) & 1]) for m in masks])
    variants = F.concat(F.array(F.lit(0).cast("long")), F.get(free, F.col("root")))
    keyed = routed.join(large, ["root", "head"]).select("root", "fp", F.explode(variants).alias("bit"))
    keyed = keyed.select("root", F.col("fp").bitwiseXOR(F.col("bit")).alias("key"), "fp")
    stars = keyed.groupBy("root", "key").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("v"))  # 33 codes at most
    stars = stars.where(F.size("fps") > 1).select(F.explode("fps").alias("u"), "v").where("u != v")
    return searched.union(stars)


def count_codes(printed: DataFrame, row_id: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """The values of ``name`` (``fp``), written, with how many rows each has (``n``) and which of them comes ``first``."""
    ident = F.col(f"`{row_id}`")
    order = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col(name).alias("fp"))
    return settle(printed.groupBy(F.col(name).alias("fp")).agg(F.min(order).alias("first"), F.count("*").alias("n")), "codes")


def group_near_copies(printed: DataFrame, row_id: str = "doc_id", name: str = "fingerprint", salts: int = SALTS) -> DataFrame:
    """Rows of ``printed`` (``with_fingerprints``, written or settled) with ``component_id`` and ``kept``.

    Fingerprints are linked that differ in MAX_BITS bits at most (``link_codes``); rows, ids and ties are as in ``group_linked``.
    """
    codes = count_codes(printed, row_id, name)
    return group_linked(printed, codes, link_codes(codes.select("fp")), row_id, name, salts)


def group_linked(printed: DataFrame, codes: DataFrame, links: DataFrame, row_id: str, name: str, salts: int = SALTS) -> DataFrame:
    """Rows of ``printed`` with ``component_id`` and ``kept``, by edges (u, v) over the values of ``name``.

    ``codes`` are ``count_codes`` of the same rows. ``component_id`` is the smallest id of all rows that links reach, the row
    itself included. Copies share a value and are counted once. ``kept`` is true
    for one row of each component, one with that smallest id. A null id counts as larger than
    any other; a component with only null ids has a null ``component_id`` and keeps one row.
    Columns named like the new ones are replaced; an empty table gives an empty one.
    """
    printed = without(printed, "component_id", "kept")
    salt, first, found, may = fresh(printed, "salt_", "first_", "found_", "may_")
    ident = F.col(f"`{row_id}`")
    parts = connected_components(links).select(F.col("u").alias("fp"), F.col("v").alias("least"))
    placed = codes.join(parts, "fp", "left").withColumn("least", F.coalesce("least", "fp"))
    groups = placed.groupBy("least").agg(F.min("first").alias(first), F.sum("n").alias("rows")).where("rows > 1")
    groups = placed.join(groups, "least").select(F.col("fp").alias(name), first)
    groups = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    groups = settle(groups, "groups")

    # a filter of fixed size tells rows that are surely alone, and those are never shuffled
    own = [F.col(f"`{c}`") for c in printed.columns]
    slot = slot_of(F.xxhash64(name))
    tested = test_filter(printed, slot, bit_filter(groups.where(F.col(salt) == 0).select(slot.alias("slot"))), may)
    alone = tested.where(~F.col(may)).select(*own, ident.alias("component_id"), F.lit(True).alias("kept"))
    salted = tested.where(F.col(may)).withColumn(salt, F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int"))
    joined = salted.join(groups.withColumn(found, F.lit(True)), [name, salt], "left")
    place = F.row_number().over(Window.partitionBy(name, salt, f"`{row_id}`").orderBy(F.lit(1)))
    single = F.col(found).isNull()
    is_first = F.col(f"{first}.id").eqNullSafe(ident) & (F.col(f"{first}.fp") == F.col(name))
    told = joined.select(
        *own,
        F.when(single, ident).otherwise(F.col(f"{first}.id")).alias("component_id"),
        (single | (is_first & (place == 1))).alias("kept"),
    )
    return alone.union(told)


def drop_near_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of near copies."""
    aside, restore = set_aside(docs, "component_id", "kept")
    (name,) = fresh(aside, "fingerprint_")
    printed = settle(with_fingerprints(aside, text, name), "fingerprints")
    return group_near_copies(printed, row_id, name).where("kept").select(*restore)
