"""Near copies by their whole texts: SimHash fingerprints and MinHash bands bring texts together, exact Jaccard similarity links them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.components import connected_components
from factorloom.llm.filters import bit_filter, slot_of, test_filter
from factorloom.llm.simhash import count_codes, group_linked, link_codes, shingle_hashes, with_fingerprints
from factorloom.llm.text import body, fresh, ready_for_python, set_aside, without
from factorloom.session import settle

#: Words of a shingle.
WIDTH = 5
#: Texts whose sets of shingles are this similar are linked.
SIMILARITY = 0.8
#: Bands, and smallest hashes that make a band's key: a pair at SIMILARITY shares a key with probability
#: 1 - (1 - 0.8 ** 5) ** 25, that is 0.99995.
BANDS, BAND_HASHES = 25, 5
#: Texts of one key that are compared all with all; more of them are dealt into blocks of about this many.
BLOCK = 256
#: Slots in which shingles of crowded texts are counted, to order them from rare to frequent.
SLOTS = 1 << 18
#: Shingles that are hashed anew at a time.
AT_ONCE = 2048

_CONSTANTS = np.array([[xxhash.xxh64_intdigest(b"%d" % i, seed) for i in range(BANDS * BAND_HASHES)] for seed in (1, 2)], np.uint64)
FACTORS, SHIFTS = _CONSTANTS[0] | np.uint64(1), _CONSTANTS[1]


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of a text's different shingles, ascending; a text of fewer words is one shingle, an empty one has none."""
    return np.unique(shingle_hashes(text, WIDTH))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key a band, as signed numbers."""
    least = np.full(BANDS * BAND_HASHES, ~np.uint64(0))
    for i in range(0, len(shingles), AT_ONCE):
        least = np.minimum(least, (shingles[i : i + AT_ONCE, None] * FACTORS + SHIFTS).min(0))
    bands = least.reshape(BANDS, BAND_HASHES)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def with_sketches(docs: DataFrame, text: str, sketch: str) -> DataFrame:
    """``docs`` with ``sketch``: ``shingles`` (a hash of the set of shingles), ``size`` and band ``keys``."""
    docs = without(docs, sketch)
    ready_for_python(docs.sparkSession)
    kind = pa.struct([("shingles", pa.int64()), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("shingles long, size int, keys array<long>")
    def sketched(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            own = shingle_set(t.as_py())
            mark = np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0]
            out.append({"shingles": int(mark), "size": len(own), "keys": band_keys(own)})
        return pa.array(out, kind)

    return docs.withColumn(sketch, sketched(F.col(f"`{text}`")))


def similar_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Index pairs that connect all sets linked by a Jaccard similarity of ``similarity`` or more.

    A search goes out from every set once and leaves out the sets that are already reached.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.r_[0, np.cumsum(sizes)]
    owner, marked = np.repeat(np.arange(len(sets)), sizes), np.zeros(ids.max(initial=-1) + 1, bool)
    open_, a, b = np.ones(len(sets), bool), [], []
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start], queue = False, [start]
        while queue and open_.any():
            at = queue.pop()
            marked[:] = False
            marked[ids[bounds[at] : bounds[at + 1]]] = True
            both = np.bincount(owner[marked[ids]], minlength=len(sets))
            found = np.flatnonzero(open_ & (both >= similarity * (sizes + sizes[at] - both) - 1e-9))
            open_[found] = False
            queue += found.tolist()
            a += found.tolist()
            b += [at] * len(found)
    return a, b


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the blocks of a partition that is sorted by key and block."""
    held: dict[int, np.ndarray] = {}
    now = None

    def links() -> pa.RecordBatch:
        names, sets = np.array(list(held), np.int64), list(held.values())
        a, b = similar_links(sets) if len(sets) > 1 else ([], [])
        return pa.record_batch({"u": pa.array(names[a] if a else [], pa.int64()), "v": pa.array(names[b] if b else [], pa.int64())})

    for batch in batches:
        for key, block, name, raw in zip(*(batch[c] for c in ("key", "block", "fp", "hashes")), strict=True):
            if (key.as_py(), block.as_py()) != now:
                if len(held) > 1:
                    yield links()
                held, now = {}, (key.as_py(), block.as_py())
            held[name.as_py()] = np.frombuffer(raw.as_py(), np.uint64)
    if len(held) > 1:
        yield links()


def _prefix_tokens(ranks: np.ndarray, mask: int):
    """Rows of a text's rarest shingles: the token and whether it stands in the short prefix.

    Of two linked sets with sizes x <= y the smaller shares one of its first x - t(x, x) + 1 shingles with the first
    y - t(y) + 1 of the larger, t being the least overlap of a pair at SIMILARITY, in any one order of all shingles.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, short = [], [], []
            for fp, raw in zip(batch["fp"].to_pylist(), batch["hashes"], strict=True):
                own = np.frombuffer(raw.as_py(), np.uint64)
                n = len(own)
                own = own[np.lexsort((own, ranks[(own & np.uint64(mask)).astype(np.int64)]))]
                long_prefix = n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1
                short_prefix = n - int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9)) + 1
                names += [fp] * long_prefix
                keys += own[:long_prefix].view(np.int64).tolist()
                short += [i < short_prefix for i in range(long_prefix)]
            yield pa.record_batch({"fp": pa.array(names, pa.int64()), "token": pa.array(keys, pa.int64()), "short": pa.array(short, pa.bool_())})

    return tokens


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a partition have a shingle in each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for raw in batch["hashes"]:
            own = np.frombuffer(raw.as_py(), np.uint64) & np.uint64(SLOTS - 1)
            counts += np.bincount(own.astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(counts)
    yield pa.record_batch({"slot": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})


def link_crowded(sets: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join what ``links`` leave apart among ``sets`` (fp, hashes): with them no link of two texts is lost.

    Linked sets share one of their rarest shingles (``_prefix_tokens``), so the texts of each such shingle meet, unless ``links``
    join all of them already. The order is that of counts in SLOTS slots, a table of fixed size; any order is exact, rare
    shingles first leave out passages that all texts share. A shingle of more texts than a block is dealt into pairs of
    blocks, its short-prefix texts against all, so every such pair is compared and a task holds two blocks at most.
    """
    counts = settle(sets.select("hashes").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    ranks = np.zeros(SLOTS, np.int64)
    got = counts.toArrow()  # SLOTS rows at most
    ranks[got["slot"].to_numpy()] = got["n"].to_numpy()
    tokens = sets.mapInArrow(_prefix_tokens(ranks, SLOTS - 1), "fp long, token long, short boolean")
    parts = connected_components(links).select(F.col("u").alias("fp"), F.col("v").alias("least"))
    tokens = settle(tokens.join(parts, "fp", "left").withColumn("least", F.coalesce("least", "fp")), "tokens")
    mark = F.sum(F.xxhash64("fp", "short").cast("decimal(38,0)")).alias("mark")
    groups = tokens.groupBy("token").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.count("*").alias("n"), F.count_if("short").alias("n_short"), mark)
    # shingles of the same texts are compared once
    groups = groups.where("lo < hi AND n_short > 0").groupBy("mark", "n", "n_short").agg(F.min("token").alias("token"))
    parted = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    groups = settle(groups.select("token", parted("n_short").alias("rows"), parted("n").alias("cols")), "crowds")
    met = tokens.join(groups, "token").withColumns({
        "row": F.pmod(F.xxhash64("fp", "token"), F.col("rows")).cast("int"), "col": F.pmod(F.xxhash64("token", "fp"), F.col("cols")).cast("int")})
    cell = lambda row, col: row.cast("long") * F.col("cols") + col
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a text of the long prefix meets every row of blocks, one of the short prefix every column as well
    as_col = met.select("fp", F.col("token").alias("key"), F.explode(F.transform(upto("rows"), lambda r: cell(r, F.col("col")))).alias("block"))
    as_row = met.where("short").select("fp", F.col("token").alias("key"), F.explode(F.transform(upto("cols"), lambda c: cell(F.col("row"), c))).alias("block"))
    return search_blocks(as_col.union(as_row).distinct(), sets)


def search_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) inside each (key, block) of ``members`` (key, block, fp)."""
    placed = members.join(sets, "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    return placed.select("key", "block", "fp", "hashes").mapInArrow(_search_blocks, "u long, v long")


def fingerprint_keys(printed: DataFrame, sketch: str, name: str) -> DataFrame:
    """(fp, size, key) of the texts with a word: one key a component of fingerprints ``name`` that op9's index links.

    Texts within its distance share the key, whether the index has an edge between them or a path.
    """
    own = F.col(f"`{sketch}`")
    texts = printed.where(own["size"] > 0).select(own["shingles"].alias("fp"), own["size"].alias("size"), F.col(f"`{name}`").alias("code"))
    codes = settle(texts.select(F.col("code").alias("fp")).distinct(), "codes")
    parts = connected_components(link_codes(codes)).select(F.col("u").alias("code"), F.col("v").alias("least"))
    key = F.xxhash64(F.lit("fingerprint"), F.coalesce("least", "code"))
    return settle(texts.distinct().join(parts, "code", "left").select("fp", "size", key.alias("key")).distinct(), "printed")


def link_texts(sketched: DataFrame, text: str, sketch: str, block: int = BLOCK, fingerprint: str | None = None) -> DataFrame:
    """Edges (u, v) over the ``shingles`` of ``sketched`` (``with_sketches``, written) that join near copies.

    Every edge has an exact Jaccard similarity of SIMILARITY or more over whole texts. Texts that
    share a band's key meet, and so do those whose ``fingerprint`` (a column of ``with_fingerprints``, if named)
    ``fingerprint_keys`` brings together. Up to ``block`` of them are all compared; more are dealt by hash into
    blocks, anew for each band, and each block also gets the key's smallest text, which edited
    copies of it resemble more than each other. What that leaves apart among texts of keys with more than a block,
    ``link_crowded`` finds exactly; so a task holds a block or two at a time whatever the size of a group.
    """
    ready_for_python(sketched.sparkSession)
    own = F.col(f"`{sketch}`")
    banded = sketched.where(own["size"] > 0).select(own["shingles"].alias("fp"), own["size"].alias("size"), F.explode(own["keys"]).alias("key"))
    if fingerprint:
        banded = banded.union(fingerprint_keys(sketched, sketch, fingerprint))
    mark = F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mark")
    buckets = banded.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n"), F.min(F.struct("size", "fp")).alias("hub"), mark)
    buckets = buckets.where("lo < hi").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    # keys of the same texts, if no more than a block, are compared once
    alike = F.when(F.col("blocks") > 1, F.col("key")).alias("own")
    buckets = buckets.groupBy("mark", "n", "blocks", alike).agg(F.min("key").alias("key"), F.min("hub.fp").alias("hub"))
    buckets = settle(buckets.select("key", "blocks", "hub"), "buckets")
    dealt = banded.join(buckets.select("key", "blocks"), "key")
    dealt = dealt.select("key", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int").alias("block"), "fp")
    hubs = buckets.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("fp"))
    members = settle(dealt.union(hubs).distinct(), "members")

    # a filter of fixed size tells texts that share no key, and those are never shuffled
    (may,) = fresh(sketched, "may_")
    slot = slot_of(F.xxhash64(own["shingles"]))
    slots = members.select("fp").distinct().select(slot_of(F.xxhash64("fp")).alias("slot"))
    tested = test_filter(sketched.where(own["size"] > 0), slot, bit_filter(slots), may).where(F.col(may))

    @F.arrow_udf("binary")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py()).tobytes() for t in texts], pa.binary())

    whole = tested.select(own["shingles"].alias("fp"), F.col(f"`{text}`").alias("text")).dropDuplicates(["fp"])
    sets = settle(whole.select("fp", hashed(F.col("text")).alias("hashes")), "sets")
    links = search_blocks(members, sets)
    large = buckets.where("blocks > 1").select("key")
    if large.isEmpty():
        return links
    links = settle(links, "links")
    crowded = members.join(large, "key").select("fp").distinct()
    return links.union(link_crowded(settle(sets.join(crowded, "fp"), "crowded"), links, block))


def drop_near_copies(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of near copies, one with its smallest id.

    Texts are linked by ``link_texts``, which SimHash fingerprints and MinHash bands bring together; equal sets of shingles are always copies, and so are null and empty texts of
    each other. Ids and ties are as in ``group_linked``; an empty table gives an empty one.
    """
    aside, restore = set_aside(docs, "component_id", "kept")
    sketch, name, code = fresh(aside, "sketch_", "shingles_", "fingerprint_")
    sketched = settle(with_fingerprints(with_sketches(aside, text, sketch), text, code), "sketches")
    links = settle(link_texts(sketched, text, sketch, fingerprint=code), "links")
    printed = sketched.withColumn(name, F.col(f"`{sketch}`.shingles")).drop(sketch, code)
    return group_linked(printed, count_codes(printed, row_id, name), links, row_id, name).where("kept").select(*restore)
