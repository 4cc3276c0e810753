"""Ordered target statistics: category levels as smoothed means of the target on earlier days.

A level's value at a day is ``(sum + weight * prior) / (count + weight)`` over the rows of that level
on strictly earlier days; the prior is the mean of all rows on earlier days (zero before the first).
So no row sees its own day or a later one, and one table of training rows serves every fold. Rows
past an origin take the value of the level at the origin. The number of levels is not limited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import saved

WEIGHT = 20.0  # rows that the prior counts for


def stat_name(col: str) -> str:
    return f"{col}_stat"


def _smoothed(total: Column, n: Column, prior: Column, weight: float) -> Column:
    # Rounded, so that the order in which sums are made does not reach the fits.
    return F.round((F.coalesce(total, F.lit(0.0)) + F.lit(weight) * prior) / (F.coalesce(n, F.lit(0)) + F.lit(weight)), 12)


def daily_priors(rows: DataFrame, label: Column, date_col: str = "date") -> DataFrame:
    """``_day`` and ``_prior``, the mean label of all earlier days; one row per day."""
    days = rows.groupBy(F.col(date_col).alias("_day")).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.sum("_s").over(before) / F.nullif(F.sum("_n").over(before), F.lit(0))
    return days.select("_day", F.coalesce(mean, F.lit(0.0)).alias("_prior"))


def level_statistics(
    rows: DataFrame, col: str, label: Column, *, date_col: str = "date", weight: float = WEIGHT, priors: DataFrame | None = None,
) -> DataFrame:
    """``_level``, ``_day`` and the statistic of every level on every day it has rows.

    Rows collapse to one per level and day before the shuffle; a window holds one level's days.
    """
    daily = rows.groupBy(F.col(col).alias("_level"), F.col(date_col).alias("_day")).agg(
        F.sum(label).alias("_s"), F.count(label).alias("_n"))
    before = Window.partitionBy("_level").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    running = daily.select("_level", "_day", F.sum("_s").over(before).alias("_s"), F.sum("_n").over(before).alias("_n"))
    # One row per calendar day.
    joined = running.join(F.broadcast(daily_priors(rows, label, date_col) if priors is None else priors), "_day")
    return joined.select("_level", "_day", _smoothed(F.col("_s"), F.col("_n"), F.col("_prior"), weight).alias(stat_name(col)))


def ordered_statistics(
    rows: DataFrame, cols: Sequence[str], label: Column, *, date_col: str = "date", weight: float = WEIGHT, key: str = "store_nbr",
) -> DataFrame:
    """``rows`` with ``<col>_stat`` for each category; NULL is a level of its own.

    ``key`` is the category by which a panel lies: its statistics are made where the rows are and meet
    them there. Statistics of the other categories are stored first, so that Spark knows their size
    when it plans the join, and the rows don't move for a small table.
    """
    if not cols:
        return rows
    priors = saved(daily_priors(rows, label, date_col), "priors")
    out = rows
    for col in cols:
        stats = level_statistics(rows, col, label, date_col=date_col, weight=weight, priors=priors)
        if col == key:
            known = stats.where(F.col("_level").isNotNull()).withColumnsRenamed({"_level": col, "_day": date_col})
            out = out.join(known.hint("shuffle_hash"), [col, date_col], "left").select(*out.columns, stat_name(col))
            # The level NULL: one row per calendar day.
            unnamed = rows.where(F.col(col).isNull()).withColumn(col, F.lit(0))
            none = saved(level_statistics(unnamed, col, label, date_col=date_col, weight=weight, priors=priors).select(
                "_day", F.col(stat_name(col)).alias("_none")), "levels")
            out = out.join(F.broadcast(none), F.col(date_col) == F.col("_day"), "left").withColumn(
                stat_name(col), F.when(F.col(col).isNull(), F.col("_none")).otherwise(F.col(stat_name(col)))).drop("_day", "_none")
        else:
            match = F.col(col).eqNullSafe(F.col("_level")) & (F.col(date_col) == F.col("_day"))
            out = out.join(saved(stats, "levels"), match, "left").drop("_level", "_day")
    return out


def origin_statistics(
    rows: DataFrame, history: DataFrame, cols: Sequence[str], label: Column, *, weight: float = WEIGHT,
) -> DataFrame:
    """``rows`` with ``<col>_stat`` from all of ``history``; a level without history gets the prior."""
    out = rows
    prior = F.coalesce(history.agg(F.avg(label)).scalar(), F.lit(0.0))
    for col in cols:
        levels = history.groupBy(F.col(col).alias("_level")).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
        joined = out.join(levels, F.col(col).eqNullSafe(F.col("_level")), "left")
        out = joined.withColumn(stat_name(col), _smoothed(F.col("_s"), F.col("_n"), prior, weight)).drop("_level", "_s", "_n")
    return out
