"""Near-duplicates by 64-bit SimHash with deletion-variant signatures.

With at most four differing bits, one of three segments differs by at most one bit. Every segment is
therefore indexed once for each of its bits, with that bit left out: two segments that differ by at
most one bit share such a variant. An equality join on the variants finds the candidates, and the
join's own condition verifies them and takes each pair at one variant only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.components import connected_components
from tidepanel.session import saved

SEED = 42
WHITE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPLIT = bytes(32 if c in WHITE else c for c in _LOWER)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a whole text; a bit is set if it is in more than half of the shingles' hashes."""
    words = (text or "").encode().translate(_SPLIT).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns to carry of every row."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *carry])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *[docs.schema[c] for c in carry]])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *carry).mapInArrow(hash_texts, schema)


def _segments(bits: int) -> list[tuple[int, int]]:
    """First bit and width of the segments: so many that one differs by at most one of ``bits`` bits."""
    n = (bits + 2) // 2
    ends = [64 * (i + 1) // n for i in range(n)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def _mask(first: int, width: int) -> int:
    return int(np.uint64((1 << width) - 1 << first).astype(np.int64))


def linked_pairs(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Pairs a < b of the distinct longs in ``fp`` that differ by at most ``bits`` bits, each once."""
    segments = _segments(bits)
    variants = [(s, _mask(j, 1), _mask(first, width) & ~_mask(j, 1)) for s, (first, width) in enumerate(segments) for j in range(first, first + width)]
    keys = F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(bit).alias("bit"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for s, bit, m in variants
    ])).alias("v")
    index = fps.select("fp", keys).select("fp", "v.s", "v.bit", "v.key")
    a, b = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))

    def part(s: int) -> Column:
        return diff.bitwiseAND(F.lit(_mask(*segments[s])))

    # The variant that counts: the first segment with at most one differing bit; that bit, or the lowest if none differs.
    chosen = F.lit(False)
    earlier = F.lit(True)
    for s, (first, _) in enumerate(segments):
        one = F.when(part(s) == 0, F.col("a_bit") == _mask(first, 1)).otherwise(part(s) == F.col("a_bit"))
        chosen = chosen | ((F.col("a_s") == s) & earlier & one)
        earlier = earlier & (F.bit_count(part(s)) > 1)
    left = a.select("a", F.col("s").alias("a_s"), F.col("bit").alias("a_bit"), F.col("key").alias("a_key"))
    match = (F.col("a_s") == F.col("s")) & (F.col("a_bit") == F.col("bit")) & (F.col("a_key") == F.col("key")) & (F.col("a") < F.col("b"))
    # Spark takes the index for as small as the fingerprints it is made of and would send it whole to every task.
    return left.join(b.hint("merge"), match & (F.bit_count(diff) <= bits) & chosen).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, shingle: int = 4, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable), ``component``.

    Texts are lower-cased in A-Z, words are runs without white space, shingles of ``shingle`` words
    count as often as they occur; fewer words make one shingle, none (null or empty text too) the
    fingerprint zero, which links like any other. Copies share a fingerprint and are one node of the
    graph, never pairs. A row with a null id takes part through its fingerprint but has no id to
    give: the ``component_id`` of such rows only is null; ``component``, one of its fingerprints as a
    long, is never. No rows in, no rows out; columns other than those in ``carry`` are not read.
    """
    marked = saved(with_fingerprints(docs, id_col, text_col, shingle, carry), "fingerprints")
    # Each fingerprint stands for its copies under their least id.
    nodes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    pairs = saved(linked_pairs(nodes.select("fp")), "links")
    # Components are found over fingerprints, then renamed to the least id among their members.
    parts = connected_components(pairs).select(F.col("node").alias("fp"), "component")
    named = nodes.join(parts, "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("component"))
    named = saved(named, "members")
    least = saved(named.groupBy("component").agg(F.min("node").alias("component_id")), "least")
    classes = saved(named.join(least, "component").select("fp", "component_id", "component"), "classes")
    return marked.join(classes, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", *carry
    )
