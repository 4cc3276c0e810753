"""Places in a total order without a window over all rows.

Rows are dealt by ranges of the order and sorted inside each range; one total per range gives what
lies before it. Only these totals (one row per range) meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import saved

ROWS_PER_RANGE = 1_000_000


def ranges_for(df: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Number of ranges for a stored table, from its row count."""
    return max(1, -(-df.count() // rows_per_range))


def in_ranges(df: DataFrame, order: Sequence[Column | str], ranges: int) -> DataFrame:
    """``df`` stored in order, with ``_part`` (its range) and ``_nth`` (place in the range, from 0)."""
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = saved(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    return placed.withColumns({
        "_part": F.shiftright("_at", 33).cast("int"), "_nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with consecutive numbers from 0 in a total order."""
    stored = saved(df, "unordered")
    placed = in_ranges(stored, order, ranges_for(stored, rows_per_range))
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    # One row per range.
    starts = F.broadcast(totals.select("_part", before.alias("_before")))
    return placed.join(starts, "_part").select(*df.columns, (F.col("_before") + F.col("_nth")).alias(name))
