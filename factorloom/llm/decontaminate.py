"""Benchmark decontamination: windows of test words in a broadcast hash set, looked up at every word of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from factorloom.llm.text import ascii_lower, fresh, ready_for_python, set_aside, without
from factorloom.session import settle

#: Words of a window; an item of fewer is one window.
WIDTH = 10
#: Pairs of window and item in a block of the benchmark, on average. A block is what is broadcast.
BLOCK_PAIRS = 250_000
#: Words of whole texts that a worker looks up at once.
BATCH_WORDS = 1 << 18
# Fixed value: what separates words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# In UTF-8 all bytes of a character beyond ASCII are above 0x7F, so words can be cut in bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FACTOR = 0x9E3779B97F4A7C15  # odd, so a window's sum of products keeps all bits of every word
_SLOTS = 22  # bits of a place in the first table of a block
_NEW = ("n_words", "hit_runs", "n_hit", "items", "contaminated")
_FOUND = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(StringType()))])


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item): each run of ``width`` words of an item, or all its words if fewer."""
    cut = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(width)), " "))
    return cut.where(F.size("w") > 0).select(F.explode(runs).alias("window"), "item").distinct()


class Block:
    """A bounded part of the windows as tables for lookups: word numbers, window hashes, items."""

    def __init__(self, pairs: list[tuple[str, str]]):
        by_window: dict[str, list[str]] = {}
        for window, item in pairs:
            by_window.setdefault(window, []).append(item)
        self.numbers: dict[bytes, int] = {}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]] = {}
        lengths: dict[int, list[tuple[list[int], list[str]]]] = {}
        for window, items in by_window.items():
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split(b" ")]
            lengths.setdefault(len(ids), []).append((ids, items))
        for n, found in lengths.items():
            ids = np.array([x for x, _ in found], np.uint64)
            keys = hashes(ids.reshape(-1), n)[::n] if n > 1 else hashes(ids.reshape(-1), 1)
            order = np.argsort(keys, kind="stable")
            slots = np.zeros(1 << _SLOTS, bool)
            slots[keys >> np.uint64(64 - _SLOTS)] = True
            self.by_length[n] = slots, keys[order], ids[order], [found[i][1] for i in order]

    def hits(self, ids: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(place, length, items) of every window in a run of word numbers; ``left``: words of the text from each place on."""
        for n, (slots, keys, windows, items) in self.by_length.items():
            if len(ids) < n:
                continue
            mixed = hashes(ids, n)
            maybe = np.flatnonzero(slots[mixed >> np.uint64(64 - _SLOTS)] & (left[: len(mixed)] >= n))
            first = np.searchsorted(keys, mixed[maybe])
            for place, k in zip(maybe.tolist(), first.tolist(), strict=True):
                here = ids[place : place + n]
                while k < len(keys) and keys[k] == mixed[place]:  # equal hashes stand together; word numbers decide
                    if np.array_equal(windows[k], here):
                        yield place, n, items[k]
                    k += 1


def hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` word numbers."""
    ids = ids.astype(np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    factor = 1
    for j in range(n):
        factor = factor * _FACTOR % (1 << 64)
        out += (ids[j : j + len(out)] + np.uint64(1)) * np.uint64(factor)
    out ^= out >> np.uint64(29)
    return out * np.uint64(_FACTOR)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, text: str, found: str, pairs: list[tuple[str, str]], stays: bool) -> DataFrame:
    """``docs`` with a column ``found``: n_words, runs of hit words [from, to), items, by one block; less the text unless it stays."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    cells = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def look(block: Block, texts: list[bytes | None]) -> list[dict]:
        cut = [(t or b"").translate(_FOLD).split() for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        get = block.numbers.get
        ids = np.fromiter((get(w, 0) for c in cut for w in c), np.uint64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(ids))
        out = [{"n_words": int(n), "runs": [], "items": set()} for n in sizes]
        for place, n, items in block.hits(ids, left):
            k = int(np.searchsorted(ends, place, "right"))
            start = place - int(ends[k] - sizes[k])
            out[k]["runs"].append((start, start + n))
            out[k]["items"].update(items)
        for row in out:
            row["runs"] = [list(r) for r in _merged(row["runs"])]
            row["items"] = sorted(row["items"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())  # a view, nothing is decoded
            rows, held, size = [], [], 0
            for t in texts:
                held.append(t.as_py())
                size += len(held[-1] or b"") // 4
                if size > BATCH_WORDS:
                    rows += look(block, held)
                    held, size = [], 0
            rows += look(block, held)
            others = [i for i, name in enumerate(batch.schema.names) if stays or name != text]
            columns = [batch.column(i) for i in others] + [pa.array(rows, cells)]
            yield pa.RecordBatch.from_arrays(columns, [*[batch.schema.names[i] for i in others], found])

    fields = [f for f in docs.schema.fields if stays or f.name != text]
    schema = StructType([*fields, StructField(found, _FOUND)])
    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, keep: list[str] | None = None,
                       block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """All rows of ``docs`` (columns ``keep``, by default all) with n_words, hit_runs, n_hit, items and contaminated.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is
    ``width`` consecutive words of an item, or all words of a shorter one. A word of a document is hit
    if it stands in an occurrence of a window; ``hit_runs`` are maximal runs [from, to) of hit words
    that windows cover together or side by side, ``n_hit`` their words, ``items`` the sorted ids (as
    strings) of items with a window in the document.

    The windows of the benchmark are made and counted in Spark. Up to ``block_pairs`` pairs of window
    and item are broadcast; a larger benchmark is dealt by a hash into blocks of that size, and the
    documents pass through one block after the other, written between passes. Nothing is
    shuffled. A hash match is checked word by word.

    Null and empty texts have no words; null and wordless items no windows, a null item id counts as
    an empty id. Repeated rows, ties of ids and long texts need nothing special. Columns named like
    the new ones are replaced. An empty table on either side is allowed.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    docs = without(docs, *_NEW)
    kept = docs.columns if keep is None else keep
    pairs = settle(windows(benchmark, width), "windows")
    blocks = max(1, -(-pairs.count() // block_pairs))
    found, earlier = fresh(docs, "found_", "earlier_")
    out = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k)
        stays = text in kept or k < blocks - 1
        out = _scan(out, text, found, [tuple(r) for r in part.collect()], stays)  # a block, by construction
        if k:
            a, b = F.col(earlier), F.col(found)
            out = out.withColumn(found, F.struct(
                b["n_words"].alias("n_words"), F.concat(a["runs"], b["runs"]).alias("runs"), F.concat(a["items"], b["items"]).alias("items"))).drop(earlier)
        if k < blocks - 1:
            out = settle(out.withColumnRenamed(found, earlier), "scanned")
    f = F.col(found)
    runs, items = f["runs"], f["items"]
    if blocks > 1:
        runs, items = _merge_runs(runs), F.array_sort(F.array_distinct(items))
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    return out.select(*[F.col(f"`{c}`") for c in kept], f["n_words"].alias("n_words"), runs.alias("hit_runs"),
                      n_hit.alias("n_hit"), items.alias("items"), (F.size(runs) > 0).alias("contaminated"))


def _merge_runs(runs: Column) -> Column:
    """Sorted runs with those that touch or overlap made one."""
    none = F.array().cast("array<array<bigint>>")

    def add(out, r):
        last = F.element_at(out, -1)
        touching = F.coalesce(F.get(r, F.lit(0)) <= F.get(last, F.lit(1)), F.lit(False))
        wider = F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), F.get(r, F.lit(1))))
        return F.when((F.size(out) > 0) & touching, F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), wider)).otherwise(F.array_append(out, r))

    return F.aggregate(F.array_sort(runs), none, add)


def cut_spans(text: str, runs: list[list[int]]) -> str:
    """The text without these runs of words and what stands between their words."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in runs:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, drop_share: float | None = None) -> DataFrame:
    """``docs`` without what is in the benchmark, in the same columns.

    Texts lose their hit spans. With ``drop_share``, a document whose hit words are at least that
    share of its words is dropped instead (0: every contaminated one). Clean rows are untouched.
    """
    moved, back = set_aside(docs, *_NEW)
    marked = find_contamination(moved, benchmark, text, width)
    if drop_share is not None:
        marked = marked.where(~F.col("contaminated") | (F.col("n_hit") < drop_share * F.col("n_words")))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, r) for t, r in zip(texts, runs, strict=True)])

    whole = F.col(f"`{text}`")
    hit = marked.where("contaminated").withColumn(text, cleaned(whole, F.col("hit_runs"))).select(*back)
    return marked.where(~F.col("contaminated")).select(*back).unionAll(hit) if drop_share != 0 else marked.select(*back)
