"""Token ids in files of fixed-width bit fields, with random access by block.

A file holds blocks of ``block_ids`` ids, each id in the least number of bits that the vocabulary
needs, then a footer with the documents' ids and places and the block offsets, and a trailer:

    block* | doc ids int64 | null flags uint8 | starts uint64 (n_docs + 1) | block offsets uint64 (n_blocks + 1)
    | magic 8 bytes | bits, block_ids uint32 | n_docs, n_ids, footer offset uint64

Everything is little-endian; id i of a block fills the bits i * bits and up, lowest bit first.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.encoder import encoder
from tidepanel.session import saved, scratch_path

MAGIC = b"TPBITS01"
TRAILER = struct.Struct("<8sIIQQQ")
END_ID = 0


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits (1 to 32), padded with zeros to a byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):  # the same layout, without going through single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = fields
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


class TokenWriter:
    """Streams documents into one file; holds one block and the footer's numbers."""

    def __init__(self, out: BinaryIO, bits: int, block_ids: int):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = self.at = 0
        self.doc_ids: list[int | None] = []
        self.starts, self.offsets = [0], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {ids.max()} needs more than {self.bits} bits")
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            whole = np.concatenate(self.rest)
            cut = len(whole) - len(whole) % self.block_ids
            for i in range(0, cut, self.block_ids):
                self._block(whole[i:i + self.block_ids])
            self.rest, self.held = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        for part in (np.array([d or 0 for d in self.doc_ids], "<i8"), null, np.array(self.starts, "<u8"), np.array(self.offsets, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.bits, self.block_ids, len(self.doc_ids), self.n_ids, self.at))
        self.out.close()


class TokenReader:
    """Random access to a file: the footer is read once, then only the blocks asked for."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids, footer = TRAILER.unpack(file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        foot = file.read_at(size - TRAILER.size - footer, footer)
        n, n_blocks = self.n_docs, -(-self.n_ids // self.block_ids)
        self.doc_ids = np.frombuffer(foot, "<i8", n)
        self.null = np.frombuffer(foot, np.uint8, n, 8 * n)
        self.starts = np.frombuffer(foot, "<u8", n + 1, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(foot, "<u8", n_blocks + 1, 17 * n + 8).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start (inclusive) to end (exclusive) of the file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            out.append(unpack(data[at:int(self.offsets[b + 1] - self.offsets[first])], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits))
        return np.concatenate(out)[start - first * self.block_ids:end - first * self.block_ids]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    block_ids: int = 4096, chunk_ids: int = 1 << 20,
) -> DataFrame:
    """Write every document's ids and an end id to files below ``folder``, in ascending id order.

    Null text counts as empty: its document holds the end id only. Rows with equal ids stay
    neighbours, null ids come first. The text is dealt by ranges of ids before it is encoded, so
    encoding runs once. A task streams into a file of a new name and hands back rows only after
    closing it; a task that is run again writes another file, and the manifest names one of them.
    Returns the manifest, one row per ``chunk_ids`` ids or less (more for one long document): part,
    path, first_doc, n_docs, first_id, n_ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        bits = max(1, (code.size - 1).bit_length())
        fs, root = _filesystem(folder)
        path, writer, cuts = "", None, [(0, 0)]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bits"
                    writer = TokenWriter(fs.open_output_stream(path), bits, block_ids)
                writer.add(doc_id, np.append(code.encode(text.as_py()), np.uint32(END_ID)))
                if writer.n_ids - cuts[-1][1] >= chunk_ids:
                    cuts.append((len(writer.doc_ids), writer.n_ids))
        if writer is not None:
            if len(writer.doc_ids) > cuts[-1][0]:
                cuts.append((len(writer.doc_ids), writer.n_ids))
            writer.close()
            part = TaskContext.get().partitionId()
            rows = [(part, path, a, b - a, i, j - i) for (a, i), (b, j) in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["part", "path", "first_doc", "n_docs", "first_id", "n_ids"])

    ordered = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toDF("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return saved(ordered.mapInArrow(write, "part long, path string, first_doc long, n_docs long, first_id long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Digest of every stored document, read back from the files.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, over the ids as
    little-endian unsigned 32-bit integers). An empty manifest gives no rows.
    """
    # One row per file, at most as many as there were writing tasks.
    files = manifest.groupBy("part", "path").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = manifest.join(files.select("path", before.alias("before")), "path").select("path", "first_doc", "n_docs", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as file:
                    reader = TokenReader(file)
                    a, b = row["first_doc"], row["first_doc"] + row["n_docs"]
                    starts = reader.starts[a:b + 1]
                    ids = reader.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                    at = starts - starts[0]
                    crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at, at[1:])]
                    doc_ids = pa.array(reader.doc_ids[a:b].astype(np.int64), mask=reader.null[a:b].astype(bool))
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids, pa.array(starts[:-1] + row["before"]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # Small rows that stand for much reading: dealt by an explicit number, which adaptive execution keeps.
    tasks = max(1, min(manifest.count(), 32 * manifest.sparkSession.sparkContext.defaultParallelism))
    return chunks.repartition(tasks, "path", "first_doc").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` below the shared folder and digest what the files hold."""
    folder = scratch_path(spark, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer), folder)
