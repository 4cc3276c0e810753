"""WARC records in ZIP packages, read back by byte ranges without extraction.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdx``, one JSON line per record with its offset and length in the first. The reader
takes the end of the file, its ZIP64 locator and the central directory, finds where a stored member
begins, and from there on reads only the ranges it needs.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.binary_tokens import _filesystem
from tidepanel.session import saved, scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Signatures and layouts of the ZIP format.
END, LOCATOR, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_END, _LOCATOR, _END64 = struct.Struct("<4s4H2LH"), struct.Struct("<4sLQL"), struct.Struct("<4sQ2H2L4Q")
_ENTRY, _LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
_FULL16, _FULL32, _ZIP64 = 0xFFFF, 0xFFFFFFFF, 0x0001
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))


class StoredZip:
    """The stored members of a ZIP file that is read by ranges only."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        tail_at = max(0, size - _END.size - _FULL16)
        tail = file.read_at(size - tail_at, tail_at)
        at = tail.rfind(END)
        while at >= 0 and at + _END.size + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: no end record")
        _, _, _, _, count, length, start, _ = _END.unpack_from(tail, at)
        if count == _FULL16 or length == _FULL32 or start == _FULL32:
            sign, _, at64, _ = _LOCATOR.unpack(file.read_at(_LOCATOR.size, tail_at + at - _LOCATOR.size))
            if sign != LOCATOR:
                raise ValueError("ZIP64 locator missing")
            sign, *_, count, length, start = _END64.unpack(file.read_at(_END64.size, at64))
            if sign != END64:
                raise ValueError("ZIP64 end record missing")
        self.entries = self._directory(file.read_at(length, start), count)

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """Name to method, size and place of the local header."""
        out, at = {}, 0
        for _ in range(count):
            sign, _, _, _, method, _, _, _, packed, size, n_name, n_extra, n_note, _, _, _, place = _ENTRY.unpack_from(data, at)
            if sign != ENTRY:
                raise ValueError("central directory damaged")
            at += _ENTRY.size
            name, extra = data[at:at + n_name].decode(), data[at + n_name:at + n_name + n_extra]
            at += n_name + n_extra + n_note
            # The ZIP64 field holds, in this order, those numbers that did not fit.
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == _ZIP64:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size, packed, place = (next(wide) if v == _FULL32 else v for v in (size, packed, place))
                extra = extra[4 + n:]
            out[name] = (method, packed, place)
        return out

    def span(self, name: str) -> tuple[int, int]:
        """First byte and length of a stored member."""
        if name not in self.entries:
            raise ValueError(f"no member {name!r}")
        method, size, place = self.entries[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"member {name!r} is compressed and can't be read by ranges")
        head = _LOCAL.unpack(self.file.read_at(_LOCAL.size, place))
        if head[0] != LOCAL:
            raise ValueError(f"local header of {name!r} damaged")
        return place + _LOCAL.size + head[-2] + head[-1], size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, size = self.span(name)
        length = size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > size:
            raise ValueError(f"bytes {offset} to {offset + length} are outside {name!r}")
        return self.file.read_at(length, start + offset)


def _page_uri(page_id: int | None) -> str:
    return f"<urn:tidepanel:page:{'null' if page_id is None else page_id}>"


def _page_of(uri: str | None) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2] if uri else "null"
    return None if tail == "null" else int(tail)


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or (payload None) a revisit with the HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = {
        "WARC-Type": "revisit" if payload is None else "response", "WARC-Record-ID": _page_uri(page_id), "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe=_VISIBLE), "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": _page_uri(refers_to) if payload is None else None, "WARC-Profile": PROFILE if payload is None else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    if len(block) < int(fields["content-length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is not what its digest says")
    return {
        "page_id": _page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page_of(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


class PackageWriter:
    """Streams records into a package on a store without seek; holds the index lines only."""

    def __init__(self, out: BinaryIO, level: int = 6):
        self.out, self.level = out, level
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at = 0
        self.lines: list[str] = []

    def add(self, page_id: int | None, url: str | None, record: bytes) -> None:
        packer = zlib.compressobj(self.level, wbits=31)
        packed = packer.compress(record) + packer.flush()
        self.data.write(packed)
        self.lines.append(json.dumps({"page_id": page_id, "url": url, "filename": DATA, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line.encode() + b"\n")
        self.zip.close()
        self.out.close()


def with_originals(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html (null for a revisit), digest, bytes and refers_to of every page.

    Of equal payloads of at least ``least_bytes`` the one with the least page_id (nulls last, then
    the least url) is the original. Only digests that occur more than once take part in the join;
    the counts are written first, so a digest that holds a third of all pages is split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).select(
        "*", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes")
    )
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    long_ = rows.where(F.col("bytes") >= least_bytes)
    # Fully equal rows are one row with a count from here on.
    per_row = long_.groupBy("digest", "page_id", "url").agg(F.count("*").alias("same"))
    groups = per_row.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "same"), order).alias("first"), F.sum("same").alias("members"))
    groups = saved(groups.where("members > 1"), "payloads")
    joined = rows.join(groups.select("digest", "first"), "digest", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisit = F.col("first").isNotNull() & ~is_first
    out = joined.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "bytes",
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), revisit.alias("revisit"),
        F.when(is_first, F.col("first.same")).alias("_same"),
    )
    once = out.where(F.coalesce("_same", F.lit(1)) == 1).drop("_same")
    if groups.where("first.same > 1").isEmpty():
        return once
    # Rows that repeat the original in id, url and payload: one response, the others revisit it.
    again = out.where("_same > 1").groupBy("page_id", "url", "digest", "bytes", "_same").agg(F.first("html").alias("html"))
    again = again.select("*", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))).alias("_nth"))
    later = F.col("_nth") > 1
    return once.unionByName(again.select(
        "page_id", "url", F.when(~later, F.col("html")).alias("html"), "digest", "bytes",
        F.when(later, F.col("page_id")).alias("refers_to"), later.alias("revisit"),
    ))


def write_packages(pages: DataFrame, folder: str, most_records: int = 50_000, most_bytes: int = 1 << 30, least_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into packages below ``folder``; returns ``path`` and ``records`` of each.

    Null html counts as empty. A package is closed at ``most_records`` (which bounds the index that
    its task holds) or ``most_bytes``. A task hands back a path only after the file is closed; one
    that is run again writes other files, and the result names one set of them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        writer, path, done = None, "", []
        for batch in batches:
            for page_id, url, html, digest, size, refers_to, revisit in zip(*(c.to_pylist() if n != "html" else c for n, c in zip(batch.schema.names, batch.columns))):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/pages-{uuid.uuid4().hex}.wacz"
                    writer = PackageWriter(fs.open_output_stream(path))
                payload = None if revisit else html.as_py().encode()
                writer.add(page_id, url, warc_record(page_id, url, payload, digest, size, refers_to, date))
                if len(writer.lines) >= most_records or writer.at >= most_bytes:
                    writer.close()
                    done.append((path, len(writer.lines)))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, len(writer.lines)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return saved(with_originals(pages, least_bytes).mapInArrow(write, "path string, records long"), "packages")


def read_packages(packages: DataFrame, with_payload: bool = False, chunk_bytes: int = 8 << 20) -> DataFrame:
    """The records of the packages whose files ``path`` names.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri and, if asked for,
    payload (null for revisits). Directories and indexes are read first and cut into runs of about
    ``chunk_bytes``; the runs are dealt evenly, so one large package is read by many tasks. No packages, no rows. A damaged package or payload raises.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as file:
                    archive = StoredZip(file)
                    entries = sorted((e["offset"], e["length"]) for e in map(json.loads, archive.read(INDEX).splitlines()))
                    start = archive.span(DATA)[0]
                out: list[list[tuple[int, int]]] = []
                held = chunk_bytes
                for offset, length in entries:
                    if held >= chunk_bytes:
                        out.append([])
                        held = 0
                    out[-1].append((start + offset, length))
                    held += length
                for run in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([[o for o, _ in run]], pa.list_(pa.int64())), pa.array([[n for _, n in run]], pa.list_(pa.int64()))],
                        ["path", "offsets", "lengths"],
                    )

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", *(["payload"] if with_payload else [])]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                fs, at = _filesystem(run["path"])
                records = []
                with fs.open_input_file(at) as file:
                    for offset, length in zip(run["offsets"], run["lengths"]):
                        record = parse_record(zlib.decompress(file.read_at(length, offset), wbits=31))
                        records.append([record[n] for n in names])
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*records))], names)

    table = saved(packages.select("path").mapInArrow(runs, "path string, offsets array<long>, lengths array<long>"), "record-runs")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string" + (", payload binary" if with_payload else "")
    # Small rows that stand for much reading: dealt by an explicit number, which adaptive execution keeps.
    tasks = min(table.count(), 32 * table.sparkSession.sparkContext.defaultParallelism)
    return table.repartition(max(1, tasks)).mapInArrow(read, schema)


def package_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages below the shared folder and read them back.

    One row per page. Null html is an empty payload, null urls are left out of the record, and a
    null page_id counts as greater than all others (``refers_to`` is null where only such pages
    share a payload). Payloads under ``least_bytes`` are always responses. Of pages that repeat an
    id, url and payload one is the response. No pages, no rows; other columns are not read.
    """
    packages = write_packages(pages, scratch_path(spark, "warc"), least_bytes=least_bytes)
    return read_packages(packages).drop("target_uri")
