"""Language identification by prediction by partial matching with frozen statistics.

Each language has a tree of byte contexts of up to three bytes. The chance of a byte is its share in
the longest context seen, or the escape chance of that context times its chance one byte shorter,
down to all bytes alike. A text costs each language a number of bits; the cheapest one is predicted.
Since the statistics are frozen, the cost of every byte after every context is worked out once, and
a text is scored with two table look-ups per byte.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text))


def _bytes(text: str) -> np.ndarray:
    """Lower-cased bytes after three spaces, so that every byte has a full context."""
    return np.frombuffer(b"   " + text.lower().encode(), np.uint8)


@dataclass
class Model:
    """``symbol`` of a byte; ``state`` of three symbols; ``bits`` of state, symbol and language."""

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    def score(self, text: str) -> np.ndarray:
        """Code length of a text in bits, one number per language."""
        total, data, n = np.zeros(len(self.languages)), _bytes(text), int(self.symbol.max()) + 1
        for at in range(ORDER, len(data), 1 << 16):
            code = self.symbol[data[at - ORDER:at + (1 << 16)]]
            context = self.state[(code[:-3] * n + code[1:-2]) * n + code[2:-1]]
            total += self.bits[context * n + code[3:]].sum(0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Cheapest language (the first of equals) and its share of the posterior; no letter: unknown, 0."""
        if text is None or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        cost = self.score(text)
        best = int(cost.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(cost[best] - cost, -1000)).sum())


def build_model(counts: list[tuple[str, bytes, int]], least: int = 2) -> Model:
    """Model of counts per language of four-byte strings (three bytes of context, then the byte).

    Shorter contexts get the sums over the bytes before. A context is kept if some language saw it
    at least ``least`` times; a byte that no language saw counts as one extra symbol. Escapes follow
    method C: seen symbols keep n / (N + d), the escape d / (N + d), for d different ones of N.
    """
    languages = sorted({lang for lang, _, _ in counts}, key=lambda s: s.encode())
    if not counts:
        return Model([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    seen = np.unique(np.frombuffer(b"".join(g for _, g, _ in counts), np.uint8))
    n = len(seen) + 1
    symbol = np.full(256, n - 1, np.int64)
    symbol[seen] = np.arange(n - 1)
    grams = np.array([symbol[list(g)] for _, g, _ in counts], np.int64).reshape(-1, 4)
    weight = np.array([c for _, _, c in counts], np.float64)
    owner = np.array([languages.index(lang) for lang, _, _ in counts], np.int64)
    base = n ** np.arange(ORDER - 1, -1, -1)
    tables: list[tuple[np.ndarray, np.ndarray]] = []  # of each order: contexts kept, cost by context, symbol and language
    offset, state = 0, np.zeros(n**ORDER, np.int32)
    for k in range(ORDER + 1):
        context = grams[:, ORDER - k:ORDER] @ base[ORDER - k:] if k else np.zeros(len(grams), np.int64)
        kept, inverse = np.unique(context, return_inverse=True)
        size = np.zeros((len(kept), len(languages)))
        np.add.at(size, (inverse, owner), weight)
        keep = size.max(1) >= least if k else np.ones(len(kept), bool)
        number = np.full(len(kept), -1)
        number[keep] = np.arange(keep.sum())
        rows = number[inverse]
        use = rows >= 0
        table = np.zeros((int(keep.sum()), n, len(languages)))
        np.add.at(table, (rows[use], grams[use, ORDER], owner[use]), weight[use])
        if k == 0:
            lower = np.full((len(table), n, len(languages)), math.log2(n))
        else:
            shorter = kept[keep] % n ** (k - 1)
            # A context that is kept is kept without its first byte, too.
            lower = tables[k - 1][1][np.searchsorted(tables[k - 1][0], shorter)]
        total, different = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = -np.log2(table / (total + different))
            escape = -np.log2(different / (total + different))
        cost = np.where(total == 0, lower, np.where(table > 0, here, escape + lower))
        tables.append((kept[keep], cost))
        if k:
            # Longer contexts overwrite the states of shorter ones.
            tail = kept[keep].astype(np.int64)
            cells = state.reshape(-1, n**k)
            cells[:, tail] = offset + np.arange(len(tail))
        offset += len(cost)
    bits = np.concatenate([c for _, c in tables]).reshape(-1, len(languages)).astype(np.float32)
    return Model(languages, symbol, state.reshape(-1), bits)


def is_held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 400, most_docs: int = 80_000) -> Model:
    """Model from a bounded sample of the labelled rows of ``docs``: about ``sample_docs`` of each language, ``most_docs`` in all.

    Labels are counted over all rows; where there are very many languages each has fewer documents,
    but none is left out: one document each at least. A language's documents are then chosen by a hash of their id
    (of their text where the id is null), so that ``sample_docs`` are expected, and used whole. The
    driver sees the counts of their four-byte strings.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).where("lang is not null and text is not null")
    draw = F.pmod(F.xxhash64(F.lit("language sample"), F.coalesce("id", "text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.withColumn("draw", draw)
    sizes = {r["lang"]: (r["n"], r["least"]) for r in drawn.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()}
    if not sizes:
        return build_model([])
    each = max(1, min(sample_docs, most_docs // len(sizes)))
    # The document drawn first stays in any case: a small share could miss a language altogether.
    share = spark.createDataFrame([(k, max(each / n, least)) for k, (n, least) in sizes.items()], "lang string, share double")
    chosen = drawn.join(F.broadcast(share), "lang").where("draw <= share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _bytes(text.as_py()).astype(np.uint32)
                by.setdefault(lang, []).append(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:])
            for lang, parts in by.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    totals = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build_model([(r["lang"], int(r["gram"]).to_bytes(4, "big"), r["n"]) for r in totals.collect()])


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400) -> DataFrame:
    """Rows of ``docs`` whose text has a language, with all their columns; learns as ``identify_language`` does.

    With nothing to learn from, every text that has a letter stays.
    """
    model = train(docs.where(~is_held_out(F.col(id_col))), text_col, lang_col, id_col, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(text: str | None) -> bool:
        if not shared.value.languages:
            return text is not None and has_letter(text)
        return shared.value.predict(text)[0] != UNKNOWN

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            yield batch.filter(pa.array([known(t.as_py()) for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400) -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score``.

    The model is learnt from rows that aren't held out and have a language; a prediction reads the
    whole text and nothing else. Text that is null or has no letter is ``und`` with score 0, and so
    is every text if there is nothing to learn from. The score is the posterior share of the
    language under equal priors. Repeated rows give repeated results; no rows in, no rows out.
    """
    held_out = is_held_out(F.col(id_col))
    model = train(docs.where(~held_out), text_col, lang_col, id_col, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long"), held_out, F.col(text_col).cast("string"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", id_col)
