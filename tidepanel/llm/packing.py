"""Best-fit packing of documents into fixed-length sequences by linear grouping.

Lengths are integers up to the sequence length, so their histogram is bounded whatever the number of
documents. The plan is made on that histogram: large lengths are put in groups of equal cardinality
and rounded up to the group's greatest, the configurations of these few sizes are optimised by
column generation, actual lengths take the places of the rounded ones, and what is left is put in by
best fit, longest first. Documents then take the plan's places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.encoder import encoder
from tidepanel.session import saved

END_ID = 0
BUCKETS = 256
BUCKET_ROWS = 100_000  # a length with more pieces than its buckets hold gets more buckets


@dataclass
class Plan:
    """Places: items ``first .. first + n - 1`` of a length, ``per`` to a sequence from ``sequence`` on, at ``offset``."""

    capacity: int
    sequences: int = 0
    places: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)
    room: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def put(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.places.append((length, first, n, sequence, per, offset))
        self.used[length] = first + n

    def leave(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            self.room.setdefault(room, []).append((sequence, n))

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def best_fit(self, counts: dict[int, int]) -> None:
        """Longest first, into the least room that holds it; new sequences when there is none."""
        for length in sorted(counts, reverse=True):
            left = counts[length]
            for room in sorted(r for r in self.room if r >= length):
                while left and self.room[room]:
                    sequence, n = self.room[room].pop()
                    left -= self._fill(length, left, sequence, n, room)
                if not self.room[room]:
                    del self.room[room]
                if not left:
                    break
            if left:
                n = -(-left // (self.capacity // length))
                self._fill(length, left, self.open(n), n, self.capacity)

    def _fill(self, length: int, left: int, sequence: int, n: int, room: int) -> int:
        """Put up to ``left`` items into ``n`` like sequences; the number put."""
        per, offset = room // length, self.capacity - room
        full = min(n, left // per)
        if full:
            self.put(length, full * per, sequence, per, offset)
            self.leave(room - per * length, sequence, full)
        rest = min(left - full * per, per) if full < n else 0
        if rest:
            self.put(length, rest, sequence + full, rest, offset)
            self.leave(room - rest * length, sequence + full, 1)
        self.leave(room, sequence + full + bool(rest), n - full - bool(rest))
        return full * per + rest


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> Plan:
    """Plan for ``counts`` items per length with ``groups`` rounded sizes above ``small``."""
    plan = Plan(capacity)
    lengths = sorted((s for s in counts if s > small), reverse=True)
    numbers = np.array([counts[s] for s in lengths])
    left = dict(counts)
    if len(lengths):
        share = max(1, -(-int(numbers.sum()) // groups))
        group = (np.cumsum(numbers) - numbers) // share  # a length stays in one group
        members = [[s for s, g in zip(lengths, group) if g == k] for k in np.unique(group)]
        sizes = np.array([m[0] for m in members])
        demand = np.array([sum(counts[s] for s in m) for m in members])
        for config, times in _configurations(sizes, demand, capacity):
            _substitute(plan, config, times, members, left)
    plan.best_fit({s: n for s, n in left.items() if n})
    return plan


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Whole parts of a linear programme's solution: configurations of sizes and their numbers."""
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(columns.T, np.ones(len(sizes)))
        new = _knapsack(sizes, price, capacity)
        if new @ price <= 1 + 1e-9:
            break
        have, step = np.linalg.solve(columns, demand), np.linalg.solve(columns, new)
        ratio = np.where(step > 1e-9, np.maximum(have, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    times = np.floor(np.maximum(np.linalg.solve(columns, demand), 0) + 1e-6).astype(int)
    return [(columns[:, j].astype(int), int(times[j])) for j in range(len(sizes)) if times[j]]


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.flatnonzero(price > 1e-12)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = order[sizes[order] <= c]
        if len(fit):
            value = best[c - sizes[fit]] + price[fit]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], pick[c] = value[k], fit[k]
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= sizes[pick[c]]
    return out


def _substitute(plan: Plan, config: np.ndarray, times: int, members: list[list[int]], left: dict[int, int]) -> None:
    """Open ``times`` sequences of a configuration and fill their places with actual lengths."""
    start = plan.open(times)
    runs = [(start, times, 0)]  # sequence, number of them, ids used
    for k in np.repeat(np.arange(len(config)), config):
        filled = []
        for sequence, n, used in runs:
            for length in members[k]:
                take = min(n, left[length])
                if take:
                    plan.put(length, take, sequence, 1, used)
                    left[length] -= take
                    filled.append((sequence, take, used + length))
                    sequence, n = sequence + take, n - take
            if n:
                filled.append((sequence, n, used))
        runs = filled
    for sequence, n, used in runs:
        plan.leave(plan.capacity - used, sequence, n)


def best_plan(counts: dict[int, int], capacity: int, choices: tuple[tuple[int, float], ...] = ((48, 1 / 4), (16, 2 / 5), (16, 1 / 2))) -> Plan:
    """The plan with the fewest sequences; a choice is the number of groups and the share of the capacity above which a length is large."""
    counts = {s: n for s, n in counts.items() if n}
    return min((grouped_plan(counts, capacity, g, int(capacity * small)) for g, small in choices), key=lambda p: p.sequences)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and end id in pieces of at most ``length``; the first takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(code.encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                ends = np.arange(len(ids) % length or length, len(ids) + 1, length)
                out += [(doc_id, p, int(a), int(b - a), zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(np.append(0, ends), ends))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into as few sequences of at most ``length`` ids as the plan finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is
    its ids and an end id (null text: the end id alone); only longer ones are cut. Sequences are
    numbered from 0 and gapless inside. Rows with equal or null ids are packed each for itself; no
    rows in, no rows out. Columns not named are not read. The driver sees one number per length, at
    most ``length`` of them; places go out as a few thousand numbers for the same reason.
    """
    pieces = saved(cut_pieces(docs, tokenizer, length, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_plan(counts, length)
    buckets = max(BUCKETS, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "start"], buckets)
    places = np.array(sorted(plan.places), np.int64).reshape(-1, 6)
    keys = places[:, 0] << 44 | places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            _, first, _, sequence, per, offset = places[np.searchsorted(keys, size << 44 | rank, side="right") - 1].T
            k = rank - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(size), batch.column(4), pa.array(sequence + k // per), pa.array(offset + k % per * size)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def rank_within(df: DataFrame, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``rank``, 0 and up within each value of ``key``, without one task per value.

    Rows of a value are dealt to ``buckets`` buckets by a hash of ``order``; the buckets'
    counts give each its first rank, and only a bucket is ordered in one place.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select(key, "_bucket", F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(first, [key, "_bucket"]).withColumn("rank", F.col("_first") + F.col("_inside")).drop("_bucket", "_inside", "_first")
