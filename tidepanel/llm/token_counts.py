"""Token counts of fields and sections from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.encoder import encoder

SCHEMA = "doc_id long, field string, section int, start long, n_bytes long, n_tokens long, n_crossing long"


def count_tokens(
    docs: DataFrame, tokenizer: str, fields: Sequence[str] = ("text",), id_col: str = "doc_id",
    separator: str = "\n\n", section_end: str = "\n",
) -> DataFrame:
    """Tokens of every section of every document, one row per section.

    A document is its fields in the order given, joined by ``separator`` (null: empty); a section
    is a stretch of a field up to and including ``section_end``, or to the end of the field. The
    whole document is encoded once. Each token spans bytes of it, and belongs to the section that
    holds its first byte; ``n_crossing`` counts those that also reach into a later one. Separators
    belong to the section before them, so the counts of a document add up to its tokens. Columns:
    doc_id, field, section (from 0 in each field), start (byte of the document), n_bytes (without
    the separator), n_tokens, n_crossing. An empty field has one section of no bytes. Columns not
    named are not read; repeated rows give repeated results; no rows in, no rows out.
    """
    names, sep, end = list(fields), separator.encode(), section_end.encode()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        widths = code.byte_lengths()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a document may have many sections
                part = batch.slice(at, 256)
                ids, columns = part.column(0), [part.column(i + 1) for i in range(len(names))]
                out: list[list] = [[], [], [], [], [], [], []]
                for r in range(part.num_rows):
                    texts = [c[r].as_py() or "" for c in columns]
                    starts, sizes, labels = _sections([t.encode() for t in texts], sep, end)
                    stops = np.cumsum(widths[code.encode(separator.join(texts))])
                    begins = np.concatenate(([0], stops[:-1])) if len(stops) else stops
                    owner = np.searchsorted(starts, begins, side="right") - 1
                    crossing = stops > np.append(starts[1:], np.iinfo(np.int64).max)[owner]
                    out[0] += [ids[r].as_py()] * len(starts)
                    out[1] += [names[f] for f, _ in labels]
                    out[2] += [s for _, s in labels]
                    for column, values in zip(out[3:], (starts, sizes, np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts)))):
                        column.append(values)
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())]
                arrays += [pa.array(np.concatenate(c).astype(np.int64)) for c in out[3:]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "field", "section", "start", "n_bytes", "n_tokens", "n_crossing"])

    chosen = docs.select(F.col(id_col).cast("long"), *[F.col(c).cast("string") for c in names])
    return chosen.mapInArrow(count, SCHEMA)


def _sections(parts: list[bytes], sep: bytes, end: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Starts, sizes and (field, section) of the sections of a document, in order.

    Only the section that ends a field may be empty, and only if the field is; an empty section
    starts where its separator does.
    """
    starts, sizes, labels, at = [], [], [], 0
    for f, part in enumerate(parts):
        pieces = [p + end for p in part.split(end)]
        pieces[-1] = pieces[-1][:-len(end)]
        if len(pieces) > 1 and not pieces[-1]:
            pieces.pop()
        for s, piece in enumerate(pieces):
            starts.append(at)
            sizes.append(len(piece))
            labels.append((f, s))
            at += len(piece)
        at += len(sep)
    return np.array(starts, np.int64), np.array(sizes, np.int64), labels
