"""Removal of repeated byte strings by bucket-pointer refinement.

A window is every string of ``length`` bytes; windows that start in more than one place are removed.
Sorting all suffixes of a corpus would cost many rows per byte, so a sieve comes first: in each
window the least hash of its ``gram``-byte strings marks an anchor, which depends on the window's
bytes alone. Neighbouring windows share an anchor and form a segment; equal windows have equal
anchors, so segments whose anchor string is unique drop out. So do those of anchors around which
all segments read the same: their windows are repeated as a whole. What is left are the places where
passages begin, end or differ. There, bytes get the names of their 8-byte strings, and names are
refined by sorting on pairs of a name and the name at a later offset, each round using those of the
round before, until they tell apart strings of ``length`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import saved

LENGTH = 400
GRAM = 128
PIECE = 1 << 19  # windows that are looked at together
Q = 8
NO_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, of its inverse, and random values of bytes."""
    n, base = PIECE + 4096, 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1], np.random.default_rng(0).integers(0, 1 << 63, 256, dtype=np.uint64)


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first and last window starts of the segments of a text; long texts in pieces."""
    power, inverse, value = _powers()
    data, w = np.frombuffer(text, np.uint8), length - gram + 1
    out = []
    for at in range(0, len(data) - length + 1, PIECE):
        part = data[at:at + PIECE + length - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value[part] * power[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # Of equal hashes the leftmost counts: places fill the low bits.
        key = h & ~np.uint64(0xFFFFF) | np.arange(len(h), dtype=np.uint64)
        blocks = np.concatenate([key, np.full(-len(key) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = n - length + 1
        anchor = (np.minimum(behind[:windows], ahead[w - 1:w - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        out.append((at + anchor[first], at + first, at + np.append(first[1:], windows) - 1))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def window_names(spans: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows of several strings, equal for equal windows, and the string of each."""
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans])
    n = len(data) - Q + 1
    gram = np.zeros(n, np.uint64)
    for k in range(Q):
        gram |= data[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    name, have = np.unique(gram, return_inverse=True)[1].astype(np.int64), Q
    while have < length:
        step = min(have, length - have)
        pair = name[:-step] * len(data) + name[step:]
        name, have = np.unique(pair, return_inverse=True)[1].astype(np.int64), have + step
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(spans)), windows)
    starts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return name[starts], owner


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), text).alias(f"k{i}") for i in (1, 2)]


def _find_segments(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cols, grams, spans = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                view = memoryview(text.as_buffer())
                anchor, first, last = segments(view, length, gram)
                owner.append(np.full(len(first), i))
                cols.append((first, last))
                grams += [xxhash.xxh3_64_digest(view[a:a + gram]) for a in anchor.tolist()]
                spans += [xxhash.xxh3_128_digest(view[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
            owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            first, last = (np.concatenate(c) for c in zip(*cols)) if cols else (np.zeros(0, np.int64),) * 2
            span = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                 pa.array(np.frombuffer(b"".join(grams), "<i8")), pa.array(span[:, 0]), pa.array(span[:, 1])],
                ["k1", "k2", "first", "last", "gram", "s1", "s2"],
            )

    return find


def _cut_spans(length: int):
    """Bytes of the segments asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, wanted = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                for at in range(0, len(wanted), 1024):
                    part = wanted[at:at + 1024]
                    spans = [text[s["first"]:s["last"] + length] for s in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s["gram"] for s in part], pa.int64()), pa.array([s["n"] for s in part], pa.int64()),
                         pa.array([batch.column(0)[row].as_py()] * len(part), pa.int64()), pa.array([batch.column(1)[row].as_py()] * len(part), pa.int64()),
                         pa.array([s["first"] for s in part], pa.int32()), pa.array(spans, pa.binary())],
                        ["gram", "n", "k1", "k2", "first", "span"],
                    )

    return cut


def _refine(length: int, chunk: int = 1 << 20):
    """Runs of repeated windows in segments that occur once, from whole groups of equal anchors."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        name, owner = window_names([r[5] for r in rows], length)
        count = np.bincount(name)[name]
        once = np.array([r[1] for r in rows]) == 1
        hit = (count > 1) & once[owner]
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        inside = np.arange(len(owner)) - np.flatnonzero(new)[owner]
        start = np.flatnonzero(hit & (new | ~np.roll(hit, 1)))
        stop = np.flatnonzero(hit & (np.roll(new, -1) | ~np.roll(hit, -1)))
        base = np.array([r[4] for r in rows])[owner[start]]
        who = owner[start]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i in who], pa.int64()), pa.array([rows[i][3] for i in who], pa.int64()),
             pa.array((base + inside[start]).astype(np.int32)), pa.array((base + inside[stop]).astype(np.int32))],
            ["k1", "k2", "first", "last"],
        )

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > chunk and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return refine


def _hash_windows(length: int):
    """Every window of a segment as a row, for anchors with too many segments to look at in one task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, n, k1, k2, first, span in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(span)
                m = len(span) - length + 1
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i:i + length]) for i in range(m)]), "<i8").reshape(-1, 2)
                same = [pa.array([v] * m, pa.int64()) for v in (gram, n, k1, k2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(first + np.arange(m, dtype=np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["gram", "n", "k1", "k2", "first", "h1", "h2"])

    return windows


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, runs in zip(*(batch.column(i) for i in range(4))):
                text = text.as_py()
                removed, spans, kept, end = 0, 0, hashlib.sha256(), 0
                for r in sorted((r["first"], r["last"] + length) for r in runs.as_py()):
                    if r[0] > end or not spans:
                        kept.update(text[end:r[0]])
                        spans, removed, end = spans + 1, removed + r[1] - r[0], r[1]
                    elif r[1] > end:
                        removed, end = removed + r[1] - end, r[1]
                kept.update(text[end:])
                out.append((k1.as_py(), k2.as_py(), removed, spans, kept.hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["k1", "k2", "n_removed", "n_spans", "sha"])

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", most_spans: int = 4096) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Texts are UTF-8 bytes (null: empty). Every byte covered by a string of ``length`` bytes that
    also starts elsewhere, in the same text or another, is removed; occurrences may overlap and are
    judged on the input. ``n_spans`` counts maximal removed runs. A repeated row counts as another
    text, so copies of ``length`` bytes or more are removed whole. Null ids are fine. No rows in, no
    rows out; other columns are not read.

    Rows are addressed by 128 bits of their text, equal texts having equal results. An anchor with
    more than ``most_spans`` different surroundings isn't gathered in one task: its windows are
    counted as rows, by 128-bit hashes.
    """
    binary = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), binary.alias("bytes")).select("id", "bytes", *_text_keys(F.col("bytes")))
    key = ["k1", "k2"]
    slim = saved(texts.select("id", *key, F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha")), "texts")
    copies = saved(slim.groupBy(*key).agg(F.count("*").alias("copies"), F.min("id").alias("one"), F.max("n_bytes").alias("n_bytes")), "copies")

    found = texts.where(F.octet_length("bytes") >= length).select(*key, "bytes").mapInArrow(_find_segments(length, gram), "k1 long, k2 long, first int, last int, gram long, s1 long, s2 long")
    found = saved(found, "segments")
    seen = found.groupBy("gram").agg(F.count("*").alias("n"), *[f(c).alias(f.__name__ + c) for c in ("s1", "s2") for f in (F.min, F.max)])
    alone = (F.col("mins1") == F.col("maxs1")) & (F.col("mins2") == F.col("maxs2"))
    # Written first: a join whose side is still being aggregated can't split a frequent anchor.
    seen = saved(seen.where("n > 1").select("gram", alone.alias("alone")), "anchor-counts")
    rep = saved(found.join(seen, "gram"), "repeated-anchors")
    several = rep.where("not alone")
    kinds = several.groupBy("gram", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct(*key, "first", "last")).alias("at"))
    kinds = saved(kinds.select("gram", "s1", "s2", "n", "at.*"), "surroundings")
    whole = rep.where("alone").select(*key, "first", "last").unionByName(
        several.join(kinds.where("n > 1").select("gram", "s1", "s2"), ["gram", "s1", "s2"], "left_semi").select(*key, "first", "last")
    )
    whole = saved(whole.distinct(), "whole-segments")

    # One copy of each text that a later step reads.
    partly = whole.select(*key).join(copies.where("copies = 1").select(*key), key, "left_semi")
    wanted = kinds.select(*key).unionByName(partly).distinct().join(copies.select(*key, "one", "copies"), key)
    kept_texts = texts.join(wanted, key).where(F.col("id").eqNullSafe(F.col("one"))).select(*key, "bytes", "copies")
    kept_texts = saved(kept_texts, "texts-with-repeats")

    crowd = saved(kinds.groupBy("gram").agg(F.count("*").alias("kinds")), "crowds")
    asked = kinds.join(crowd, "gram").select(*key, F.struct("gram", "n", "first", "last").alias("s"), (F.col("kinds") > most_spans).alias("hot"))
    span = "gram long, n long, k1 long, k2 long, first int, span binary"

    def spans_of(hot: bool) -> DataFrame:
        lists = asked.where(F.col("hot") == hot).groupBy(*key).agg(F.collect_list("s").alias("s"))
        return kept_texts.join(lists, key).select(*key, "bytes", "s").mapInArrow(_cut_spans(length), span)

    run = "k1 long, k2 long, first int, last int"
    cover = whole.unionByName(spans_of(False).repartition("gram").sortWithinPartitions("gram").mapInArrow(_refine(length), run))
    if not crowd.where(F.col("kinds") > most_spans).isEmpty():
        windows = saved(spans_of(True).mapInArrow(_hash_windows(length), "gram long, n long, k1 long, k2 long, first int, h1 long, h2 long"), "windows")
        twice = saved(windows.groupBy("gram", "h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("gram", "h1", "h2"), "repeated-windows")
        again = windows.where("n = 1").join(twice, ["gram", "h1", "h2"], "left_semi")
        cover = cover.unionByName(again.select(*key, "first", F.col("first").alias("last")))
    runs = cover.join(copies.where("copies = 1").select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = saved(kept_texts.where("copies = 1").join(runs, key).select(*key, "bytes", "runs").mapInArrow(_remove(length), "k1 long, k2 long, n_removed long, n_spans long, sha string"), "cut-texts")

    state = copies.select(*key, ((F.col("copies") > 1) & (F.col("n_bytes") >= length)).alias("gone"))
    state = saved(state.join(cut.withColumnRenamed("sha", "rest"), key, "left"), "text-results")
    gone, empty = F.col("gone"), hashlib.sha256().hexdigest()
    return slim.join(state, key).select(
        F.col("id").alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )
