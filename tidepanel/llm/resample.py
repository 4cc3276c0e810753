"""Importance resampling towards a target text by hashed word runs.

Features (runs of one or two words) are hashed block by block: the distinct features of a block are
grouped by equal length into two-dimensional byte arrays, the CRCs of a group are updated together,
one column at a time, and the buckets are scattered back to the places of the features. Buckets of
all documents are stored; counts, weights and the draw are read from there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import saved

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LONGEST_COLUMN = 512  # a longer feature is alone in its length; its columns would be single bytes


def _crc_table() -> np.ndarray:
    """CRC-32 (reflected polynomial 0xEDB88320) of each byte value."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def crc_columns(columns: np.ndarray) -> np.ndarray:
    """CRC-32 of each feature of one length; row j of ``columns`` holds byte j of all features."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for column in columns:
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def feature_crcs(words: list[bytes], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """CRC-32 of features given as numbers of ``words``: ``first``, a space and ``second`` (-1: the first alone)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    # Word bytes in a row, then one space that every joint points to.
    flat = np.frombuffer(b"".join(words) + b" ", np.uint8)
    starts = np.cumsum(sizes) - sizes
    space = len(flat) - 1
    pair = second >= 0
    left, start = sizes[first], starts[first]
    right = np.where(pair, sizes[second] + 1, 0)
    # Place of the second word less the bytes before it.
    shift = np.where(pair, starts[second] - left - 1, 0)
    length = left + right
    out = np.empty(len(first), np.uint32)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:]):
        rows = order[a:b]
        n = int(length[rows[0]])
        if n > LONGEST_COLUMN:
            for i in rows.tolist():
                crc = zlib.crc32(words[first[i]])
                out[i] = zlib.crc32(words[second[i]], zlib.crc32(b" ", crc)) if pair[i] else crc
            continue
        at = np.arange(n)[:, None]
        place = np.where(at < left[rows], start[rows] + at, np.where(at == left[rows], space, shift[rows] + at))
        out[rows] = crc_columns(flat[place])
    return out


def _blocks(texts: Iterator[str | None], most: int) -> Iterator[tuple[list[list[bytes]], list[bool]]]:
    """Lists of words that hold about ``most`` words in all, and whether each list ends its document.

    A document that goes on in the next block hands its last word on as the next list's first.
    """
    block: list[list[bytes]] = []
    ends: list[bool] = []
    held = 0
    for text in texts:
        words = (text or "").encode().translate(_WORD).split()
        at = 0
        while True:
            part = words[at:at + most - held]
            block.append(part)
            held += len(part)
            at += len(part)
            ends.append(at >= len(words))
            if held >= most:
                yield block, ends
                block, ends, held = [], [], 0
            if at >= len(words):
                break
            at -= 1
    if block:
        yield block, ends


def hashed_features(texts: Iterator[str | None], buckets: int, block_words: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and the buckets of all features of each text, in order."""
    held: list[np.ndarray] = []
    n_held = 0
    for block, ends in _blocks(texts, block_words):
        words = [w for part in block for w in part]
        vocabulary = {w: i for i, w in enumerate(set(words))}
        ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
        stops = np.cumsum([len(part) for part in block])
        joint = np.ones(len(ids), bool)
        joint[stops[stops > 0] - 1] = False  # the last word of a list has no successor
        at = np.flatnonzero(joint)
        n = max(1, len(vocabulary))
        keys, which = np.unique(ids[at] * n + ids[at + 1], return_inverse=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        names = list(vocabulary)
        first = np.concatenate([np.arange(len(names)), keys // n])
        second = np.concatenate([np.full(len(names), -1), keys % n])
        bucket = (feature_crcs(names, first, second) % buckets).astype(np.uint32) if len(names) else np.zeros(0, np.uint32)
        single, double = bucket[ids], bucket[len(names):][which]
        doubles = np.searchsorted(at, np.append(0, stops))
        for i, (a, b) in enumerate(zip(np.append(0, stops[:-1]), stops)):
            go_on = n_held > 0 or bool(held)
            # The word handed on was counted in the block before.
            own = single[a + 1:b] if go_on else single[a:b]
            held += [own, double[doubles[i]:doubles[i + 1]]]
            n_held += len(own)
            if ends[i]:
                yield n_held, np.concatenate(held)
                held, n_held = [], 0


def with_features(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and features (bucket numbers, little-endian, two bytes each if they fit) of every row."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, data = [], []
            for n, found in hashed_features((t.as_py() for t in batch.column(1)), buckets):
                counts.append(n)
                data.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "n_words", "features"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(hash_texts, "doc_id long, n_words long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: one array per task, summed in Spark; ``buckets`` numbers reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the smoothed log ratio of target to source share of each bucket, rounded down."""
    b = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def with_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the mean gain of a document's features, rounded down (none: 0)."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            for data in batch.column(2):
                found = np.frombuffer(data.as_buffer(), kind)
                sizes.append(len(found))
                weights.append(int(gains[found].sum()) // max(1, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "features").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place (from 1) in a total order, and ``_rows``, their number.

    Dealt by ranges of the order and sorted inside; one count per partition gives the places
    before it. No window sees all rows.
    """
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    totals = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort.
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    totals = totals.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(totals), "_part").select(*rows.columns, place.alias(name), "_rows")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words, by Gumbel scores around their weights.

    One row per input row: id, n_features, weight, score and rank (null if not drawn). Null and
    empty texts have no features and weight 0. Ties in score go to the smaller id, null ids last;
    rows that repeat an id have the same noise and are ranked one after the other. An empty
    target makes the buckets that are rare in the documents weigh most; no documents, no rows.
    Columns other than id and text are not read.
    """
    features = saved(with_features(docs, buckets, id_col, text_col), "hashed-features")
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(with_features(target.withColumn("_none", F.lit(None)), buckets, "_none", target_text_col), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 32))
    noise = F.floor(F.lit(-1000) * F.log(-F.log(uniform)))
    scored = saved(with_weights(features, gains).withColumn("score", F.col("weight") + noise), "scores")
    long_enough = F.col("n_words") >= least_words
    drawn = ranked(scored.where(long_enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.floor(F.col("_rows") * F.lit(percent) / 100), F.col("rank")))
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rest.select(*columns))
