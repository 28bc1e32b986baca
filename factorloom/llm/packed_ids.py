"""Token ids as fixed-width bit-packed files with block offsets and a document index."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.text import body, ready_for_python
from factorloom.llm.tokens import encoder
from factorloom.session import scratch_dir, settle

MAGIC = b"BITIDS01"
#: Ids of a block. A multiple of 8, so every block ends on a byte whatever the width.
BLOCK_IDS = 4096
#: Text bytes that one file should hold.
FILE_BYTES = 128 << 20
#: Texts encoded together.
BATCH_TEXTS = 500
TAIL = struct.Struct("<IIQQQ8s")  # width, ids of a block, ids, documents, where the footer begins, magic


def id_width(vocabulary: int) -> int:
    """Bits that every id below ``vocabulary`` fits in."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids at ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Writes one file front to back; holds one block of ids and the document index."""

    def __init__(self, sink, width: int, block_ids: int = BLOCK_IDS):
        self.sink, self.width, self.block_ids = sink, width, block_ids
        self.open, self.n_open, self.n_ids, self.at = [], 0, 0, 0
        self.offsets, self.docs, self.starts = [0], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= self.block_ids:
            self._flush(self.n_open - self.n_open % self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        for i in range(0, n, self.block_ids):
            block = pack_bits(ids[i : min(n, i + self.block_ids)], self.width)
            self.sink.write(block)
            self.at += len(block)
            self.offsets.append(self.at)
        self.open, self.n_open = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.n_open:
            self._flush(self.n_open)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.sink.write(np.array([d is None for d in self.docs], "u1").tobytes())
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(TAIL.pack(self.width, self.block_ids, self.n_ids, len(self.docs), self.at, MAGIC))
        self.sink.close()


class Reader:
    """Random access to one file: any run of ids by the blocks it touches, any document by its place."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        self.width, self.block_ids, self.n_ids, n, foot, magic = TAIL.unpack(source.read_at(TAIL.size, end - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        blocks = -(-self.n_ids // self.block_ids) + 1
        data = source.read_at(end - TAIL.size - foot, foot)
        self.offsets = np.frombuffer(data, "<u8", blocks)
        self.doc_ids = np.frombuffer(data, "<i8", n, 8 * blocks)
        self.null = np.frombuffer(data, "u1", n, 8 * (blocks + n)).astype(bool)
        self.starts = np.frombuffer(data[8 * (blocks + n) + n :], "<u8", n + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        low, high = int(self.offsets[first]), int(self.offsets[last])
        n = min(self.n_ids, last * self.block_ids) - first * self.block_ids
        got = unpack_bits(self.source.read_at(high - low, low), self.width, n)
        return got[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.starts[place]), int(self.starts[place + 1]))


def write_ids(docs: DataFrame, tokenizer: str, text: str = "text", row_id: str = "doc_id", end_id: int = 0,
              folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all rows in ascending id order into packed files; returns the written manifest.

    Manifest: part, path, n_docs, n_ids, start (ids of all files before). Rows are dealt by
    ranges of (id, hash of the text) and sorted, nulls first, so files follow each other in
    id order and repeated ids have a defined order. A task streams its rows into a file of
    its own name and returns one manifest row; only files whose row was committed count, so
    a lost or repeated task leaves at worst an unused file. ``folder`` is on a store that
    pyarrow can write and all executors see; by default the session's shared folder.

    Null text is empty: the end id alone. Other columns are not read. An empty table gives an
    empty manifest.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    folder = folder or scratch_dir(spark, "ids")
    raw = body(f"`{text}`")
    plain = docs.select(F.col(f"`{row_id}`").cast("long").alias("id"), raw.alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(3 * spark.sparkContext.defaultParallelism, -(-size // file_bytes))
    tie = F.xxhash64("text")
    ordered = plain.withColumn("tie", tie).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        coder, writer, path = encoder(tokenizer), None, f"{root}/{uuid.uuid4().hex}.ids"
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(i, BATCH_TEXTS)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = Writer(fs.open_output_stream(path), id_width(coder.vocabulary))
                ends = np.array([end_id], "<u4").tobytes()
                for doc, ids in zip(part["id"].to_pylist(), coder.encode_batch(part["text"].to_pylist(), ends), strict=True):
                    writer.add(doc, ids)
        if writer is not None:
            writer.close()
            yield pa.record_batch({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": pa.array([path]),
                "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    manifest = settle(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def read_documents(manifest: DataFrame, chunk_ids: int = 1 << 20) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32. A file is read in runs of blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                with fs.open_input_file(row["path"]) as source:
                    file, low = Reader(source), 0
                    n = len(file.doc_ids)
                    while low < n:
                        high = max(low + 1, int(np.searchsorted(file.starts, file.starts[low] + chunk_ids, "right")) - 1)
                        first = int(file.starts[low])
                        ids = file.ids(first, int(file.starts[high])).astype("<u4")
                        cuts = file.starts[low : high + 1].astype(np.int64) - first
                        crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                        yield pa.record_batch({
                            "doc_id": pa.array(file.doc_ids[low:high], pa.int64(), mask=file.null[low:high]),
                            "start": pa.array(file.starts[low:high].astype(np.int64) + row["start"], pa.int64()),
                            "n_tokens": pa.array(np.diff(cuts), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})
                        low = high

    ready_for_python(manifest.sparkSession)
    spread = manifest.repartition(3 * manifest.sparkSession.sparkContext.defaultParallelism)
    return spread.select("folder", "path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
