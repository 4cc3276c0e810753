"""Packages of WARC records: round trip against brute force, ZIP and ZIP64 directories, damage."""

import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import warc_zip
from tidepanel.llm.warc_zip import DATA, INDEX, PackageWriter, StoredZip, package_round_trip, parse_record, read_packages, warc_record, write_packages
from tidepanel.session import scratch_path

PAGE = "<html><body>" + "word " * 40 + "</body></html>"
ROWS = [
    (5, "http://a/5", PAGE), (2, "http://a/2", PAGE), (9, None, PAGE), (None, "http://a/null", PAGE), (3, "http://a/3", "short"), (4, "http://a/4", "short"),
    (6, "http://a/6", None), (7, "http://ü/ x\r\nWARC-Type: y", ""), (8, "u", "é" * 50), (1, "u", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49),
    (12, "same", PAGE + "!"), (12, "same", PAGE + "!"), (12, "same", PAGE + "!"), (13, "same", PAGE + "!"),
    (14, "a", PAGE + "?"), (14, "b", PAGE + "?"), (None, "n", PAGE + "n"), (None, "n", PAGE + "n"), (15, "long", "y" * 3_000_000), (16, "long", "y" * 3_000_000),
]


def expected(rows, least=100):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    size = lambda h: len((h or "").encode())
    out, seen = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        same = [r[0] for r in rows if digest(r[2]) == digest(html) and r[0] is not None]
        first = min(same) if same else None
        if size(html) >= least and digest(html) in seen:
            out.append((page_id, size(html), digest(html), "revisit", first))
        else:
            out.append((page_id, size(html), digest(html), "response", None))
        seen.add(digest(html))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for name in ("digest", "bytes", "first", "path", "revisit"):
        df = df.withColumn(name, F.lit("clash"))
    return df


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip_is_brute_force(spark):
    got = package_round_trip(spark, frame(spark, ROWS))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_no_pages(spark):
    assert package_round_trip(spark, frame(spark, ROWS).where("false")).collect() == []


def test_packages_are_cut_and_read_by_many_tasks(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" + "text " * 50) for i in range(200)]
    packages = write_packages(frame(spark, rows).coalesce(1), scratch_path(spark, "warc-test"), most_records=70)
    assert sorted(r.records for r in packages.collect()) == [60, 70, 70]
    records = read_packages(packages, with_payload=True, chunk_bytes=1000)
    assert records.withColumn("t", F.spark_partition_id()).select("t").distinct().count() > 3
    assert sorted((r.page_id, r.target_uri, bytes(r.payload).decode()) for r in records.collect()) == sorted(rows)
    with zipfile.ZipFile(packages.first().path) as z:  # any ZIP program can read them
        assert z.namelist() == [DATA, INDEX] and z.testzip() is None


class Piece(io.BytesIO):
    def close(self):
        self.data = self.getvalue()
        super().close()


def package(n=3):
    out = Piece()
    writer = PackageWriter(out)
    for i in range(n):
        body = f"page {i}".encode() * 30
        writer.add(i, f"u{i}", warc_record(i, f"u{i}", body, hashlib.sha256(body).hexdigest(), len(body), None, "2000-01-01T00:00:00Z"))
    writer.close()
    return out.data


def members(data):
    archive = StoredZip(pa.BufferReader(data))
    return {name: archive.read(name) for name in archive.entries}


def plain(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {name: z.read(name) for name in z.namelist()}


def test_zip64_directory(monkeypatch):
    data = package()
    assert members(data) == plain(data)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    wide = package()
    assert warc_zip.END64 in wide and warc_zip.END64 not in data
    assert members(wide) == plain(wide)


def test_many_entries_and_a_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 looks like an end record"
        for i in range(66_000):
            z.writestr(f"m{i}", b"%d" % i)
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    archive = StoredZip(pa.BufferReader(out.getvalue()))
    assert len(archive.entries) == 66_001 and archive.read("m65999") == b"65999" and archive.read("m123", 1, 2) == b"23"
    with pytest.raises(ValueError, match="compressed"):
        archive.read("packed")
    with pytest.raises(ValueError, match="outside"):
        archive.read("m1", 0, 9)


def test_damage_is_found():
    with pytest.raises(ValueError, match="not a ZIP"):
        StoredZip(pa.BufferReader(b"nothing"))
    body = b"body"
    record = warc_record(1, "u", body, hashlib.sha256(body).hexdigest(), 4, None, "2000-01-01T00:00:00Z")
    assert parse_record(record)["payload"] == body
    with pytest.raises(ValueError, match="digest"):
        parse_record(record.replace(b"body", b"bodi"))
    with pytest.raises(ValueError, match="cut short"):
        parse_record(record[:-6])
