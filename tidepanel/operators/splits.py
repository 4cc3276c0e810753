"""Walk-forward folds, nested blocks and fold-replicated panels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.sources.schemas import ENTITY, FOLD_SCHEMA


class Fold(NamedTuple):
    fold: int
    train_end: dt.date
    val_start: dt.date
    val_end: dt.date


def date_grid(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Unique dates with their position from the start and from the end (one row per day)."""
    days = df.select(F.col(date_col).alias("date")).distinct()
    return days.select(
        "date",
        (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"),
        (F.row_number().over(Window.orderBy(F.desc("date"))) - 1).alias("from_end"),
    )


def _check(**bounds: tuple[int, int]) -> None:
    for name, (value, least) in bounds.items():
        if value < least:
            raise ValueError(f"{name} must be at least {least}, got {value}")


def _trailing_blocks(grid: DataFrame, by: Sequence[str], n: int, val_days: int, gap_days: int) -> DataFrame:
    """Blocks of ``val_days`` unique dates counted from the end of the grid.

    The position from the end says which block a date validates and which block it is the
    last training date of; one aggregate per block number then yields all three bounds.
    """
    pos = F.col("from_end")
    before = pos - val_days - gap_days
    roles = grid.select(
        *by, "date", "first_date",
        F.explode(
            F.array(
                F.struct(F.floor(pos / val_days).cast("int").alias("block"), F.lit(True).alias("val")),
                F.struct(
                    F.when((before >= 0) & (before % val_days == 0),
                           F.floor(before / val_days).cast("int")).alias("block"),
                    F.lit(False).alias("val"),
                ),
            )
        ).alias("role"),
    ).where(F.col("role.block") < n)
    is_val = F.col("role.val")
    return (
        roles.groupBy(*by, F.col("role.block").alias("block"))
        .agg(
            F.max(F.when(~is_val, F.col("date"))).alias("train_end"),
            F.min(F.when(is_val, F.col("date"))).alias("val_start"),
            F.max(F.when(is_val, F.col("date"))).alias("val_end"),
            F.count_if(is_val).alias("_n_val"),
            F.min("first_date").alias("first_date"),
        )
        .where((F.col("_n_val") == val_days) & F.col("train_end").isNotNull())
    )


def expanding_folds(
    df: DataFrame, *, date_col: str = "date", n_folds: int = 3, val_days: int = 15,
    gap_days: int = 0, min_train_days: int = 365,
) -> DataFrame:
    """Expanding walk-forward folds on the unique dates present, earliest validation first."""
    _check(n_folds=(n_folds, 1), val_days=(val_days, 1), gap_days=(gap_days, 0),
           min_train_days=(min_train_days, 1))
    if date_col not in df.columns:
        raise KeyError(f"no date column {date_col!r} in {df.columns}")
    grid = date_grid(df, date_col).withColumn(
        "first_date", F.min("date").over(Window.orderBy("idx"))
    )
    blocks = _trailing_blocks(grid, [], n_folds, val_days, gap_days).where(
        F.datediff("train_end", "first_date") + 1 >= min_train_days
    )
    number = F.row_number().over(Window.orderBy("val_start")) - 1
    return blocks.select(number.cast("int").alias("fold"), "train_end", "val_start", "val_end")


def inner_folds(
    df: DataFrame, outer: Sequence[Fold], *, date_col: str = "date", val_days: int = 15, gap_days: int = 0
) -> DataFrame:
    """Last block inside each outer training slice, for nested search."""
    _check(val_days=(val_days, 1), gap_days=(gap_days, 0))
    days = df.select(F.col(date_col).alias("date")).distinct()
    per_fold = days.select(
        "date", F.explode(_fold_array(outer, lambda f: F.col("date") <= f["train_end"])).alias("f")
    ).select("date", F.col("f.fold").alias("fold"))
    by_fold = Window.partitionBy("fold")
    grid = per_fold.select(
        "fold", "date", F.min("date").over(by_fold).alias("first_date"),
        (F.row_number().over(by_fold.orderBy(F.desc("date"))) - 1).alias("from_end"),
    )
    return _trailing_blocks(grid, ["fold"], 1, val_days, gap_days).select(
        "fold", "train_end", "val_start", "val_end"
    )


def last_block(df: DataFrame, *, date_col: str = "date", val_days: int = 15, gap_days: int = 0) -> Fold:
    """Inner train / last-block validation bounds of one training slice."""
    _check(val_days=(val_days, 1), gap_days=(gap_days, 0))
    if date_col not in df.columns:
        raise KeyError(f"no date column {date_col!r} in {df.columns}")
    rows = expanding_folds(
        df, date_col=date_col, n_folds=1, val_days=val_days, gap_days=gap_days, min_train_days=1
    ).collect()
    if not rows:
        raise ValueError(
            f"insufficient unique dates for an inner split: need {val_days + gap_days + 1}"
        )
    return Fold(*rows[0])


def collect_folds(folds: DataFrame) -> list[Fold]:
    """Fold bounds on the driver (a handful of rows), checked for leakage."""
    out = [Fold(*r) for r in folds.select(*FOLD_SCHEMA.fieldNames()).orderBy("fold").collect()]
    if not out:
        raise ValueError("no folds could be built; check panel length and fold settings")
    for f in out:
        if f.train_end >= f.val_start:
            raise RuntimeError(f"fold {f.fold} leaks: train_end {f.train_end} >= val_start {f.val_start}")
    return out


def folds_frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame([tuple(f) for f in folds], FOLD_SCHEMA)


def _fold_array(folds: Sequence[Fold], keep):
    rows = [
        F.struct(
            F.lit(f.fold).alias("fold"), F.lit(f.train_end).alias("train_end"),
            F.lit(f.val_start).alias("val_start"), F.lit(f.val_end).alias("val_end"),
        )
        for f in folds
    ]
    return F.filter(F.array(*rows), keep)


def expand_folds(
    df: DataFrame, folds: Sequence[Fold], *, date_col: str = "date", lookback_days: int | None = None
) -> DataFrame:
    """Repeat each row for the folds it belongs to, with role ``train`` or ``val``.

    Fold bounds are literals, so this is a narrow projection: no join and no shuffle.
    ``lookback_days`` keeps only that much history before each origin.  Dates in the gap
    between training and validation carry role ``gap``.
    """
    date = F.col(date_col)

    def member(f):
        ok = date <= f["val_end"]
        if lookback_days is not None:
            ok = ok & (date > F.date_sub(f["train_end"], lookback_days))
        return ok

    out = df.withColumn("_f", F.explode(_fold_array(folds, member)))
    role = F.when(date <= F.col("_f.train_end"), "train").when(
        date >= F.col("_f.val_start"), "val"
    ).otherwise("gap")
    return out.select(
        *df.columns, F.col("_f.fold").alias("fold"), F.col("_f.train_end").alias("train_end"),
        F.col("_f.val_start").alias("val_start"), role.alias("role"),
    )


def near_origin(df: DataFrame, fold: Fold, history: int, *, entity_cols: Sequence[str] = ENTITY, date_col: str = "date") -> DataFrame:
    """The last ``history`` rows of each entity up to the origin, however many days they span, and the rows after it."""
    date = F.col(date_col)
    back = Window.partitionBy(*entity_cols).orderBy(F.desc(date_col)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.count_if(date <= F.lit(fold.train_end)).over(back)
    return df.where(date <= F.lit(fold.val_end)).withColumn("_back", known).where(F.col("_back") <= history).drop("_back")


def fold_ranges(df: DataFrame, folds: Sequence[Fold], *, date_col: str = "date") -> DataFrame:
    """Row counts and observed date bounds per fold; rows are counted per day first."""
    d, role, n = F.col(date_col), F.col("role"), F.col("_n")
    per_day = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_n"))
    return (
        expand_folds(per_day, folds, date_col=date_col)
        .groupBy("fold")
        .agg(
            F.min(F.when(role == "train", d)).alias("train_start"),
            F.max(F.when(role == "train", d)).alias("train_max"),
            F.min(F.when(role == "val", d)).alias("val_min"),
            F.max(F.when(role == "val", d)).alias("val_max"),
            F.sum(F.when(role == "train", n).otherwise(0)).alias("n_train"),
            F.sum(F.when(role == "val", n).otherwise(0)).alias("n_val"),
        )
    )


def leakage_report(df: DataFrame, folds: Sequence[Fold], *, gap_days: int = 0, date_col: str = "date") -> DataFrame:
    """Strict order and observed calendar gap per fold, from the rows themselves."""
    gap = F.datediff("val_min", "train_max")
    return fold_ranges(df, folds, date_col=date_col).select(
        "fold", "train_max", "val_min", gap.alias("gap_observed"),
        ((F.col("train_max") < F.col("val_min")) & (gap >= gap_days)).alias("is_safe"),
    )


def holdout_flags(df: DataFrame, train_end, *, days: int = 15, date_col: str = "date") -> DataFrame:
    """Mark the last calendar days of training as early-stopping holdout."""
    start = F.date_sub(F.lit(train_end).cast("date"), days - 1)
    return df.where(F.col(date_col) <= F.lit(train_end).cast("date")).withColumn(
        "is_holdout", F.col(date_col) >= start
    )


def holdout_usable(df: DataFrame, min_fit: int = 1, min_holdout: int = 1) -> bool:
    """Whether both sides of the holdout have rows."""
    n = df.agg(F.count_if(~F.col("is_holdout")).alias("fit"), F.count_if("is_holdout").alias("es")).first()
    return n["fit"] >= min_fit and n["es"] >= min_holdout


def is_nested(inner: Fold, outer: Fold) -> bool:
    """The inner split stays inside the outer training slice."""
    return inner.val_end <= outer.train_end and inner.train_end < inner.val_start
