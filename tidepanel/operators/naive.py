"""Last-value and seasonal-naive forecasts for all folds in one aggregation.

Each entity is reduced map-side to its last value, the ``period`` days before every origin
and its forecast rows; one shuffle of that small state yields every fold's forecasts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.splits import Fold
from tidepanel.sources.schemas import ENTITY


def _last_known(y: Column, date: Column, origin: Column) -> Column:
    return F.max_by(y, F.when(y.isNotNull() & (date <= origin), date))


def last_value_predict(
    history: DataFrame, future: DataFrame, *, entity_cols: Sequence[str] = ENTITY,
    date_col: str = "date", target_col: str = "sales",
) -> DataFrame:
    """Last non-null target per entity, 0 for entities without history."""
    known = history.where(F.col(target_col).isNotNull()).groupBy(*entity_cols).agg(
        F.max_by(target_col, date_col).alias("_last")
    )
    return future.join(known, list(entity_cols), "left").select(
        *future.columns, F.coalesce(F.col("_last"), F.lit(0.0)).alias("y_pred")
    )


def seasonal_steps(date: Column, origin: Column, period: int) -> Column:
    """Number of whole periods to step back so that the source day is not after the origin."""
    return F.greatest(F.ceil(F.datediff(date, origin) / F.lit(period)).cast("int"), F.lit(1))


def seasonal_lookup(
    df: DataFrame, period: int, *, entity_cols: Sequence[str] = ENTITY, date_col: str = "date", target_col: str = "sales",
    name: str = "seasonal",
) -> DataFrame:
    """``df`` with the target exactly ``period`` days earlier, NULL where that day has no row.

    A RANGE frame over day numbers inside the entity's window: gaps don't shift it, and on a panel
    bucketed by entity nothing is shuffled or joined.
    """
    if period < 1:
        raise ValueError(f"period must be at least 1, got {period}")
    day = F.unix_date(F.col(date_col).cast("date"))
    frame = Window.partitionBy(*entity_cols).orderBy(day).rangeBetween(-period, -period)
    return df.withColumn(name, F.last(target_col).over(frame))


def seasonal_naive_predict(
    history: DataFrame, future: DataFrame, *, entity_cols: Sequence[str] = ENTITY,
    date_col: str = "date", target_col: str = "sales", period: int = 7, train_end=None,
    fallback: bool = True,
) -> DataFrame:
    """Value ``k`` periods earlier; then the last value (if ``fallback``); then 0.

    ``train_end`` defaults to the last history date, found by a scalar subquery.
    """
    if period < 1:
        raise ValueError(f"period must be at least 1, got {period}")
    origin = (
        F.lit(train_end).cast("date")
        if train_end is not None
        else history.agg(F.max(date_col)).scalar()
    )
    keys = list(entity_cols)
    steps = seasonal_steps(F.col(date_col), origin, period)
    wanted = future.withColumn("_src", F.date_sub(F.col(date_col), steps * period))
    source = history.select(*keys, F.col(date_col).alias("_src"), F.col(target_col).alias("_y"))
    out = wanted.join(source, [*keys, "_src"], "left")
    if fallback:
        known = history.where(F.col(target_col).isNotNull()).groupBy(*keys).agg(
            F.max_by(target_col, date_col).alias("_last")
        )
        out = out.join(known, keys, "left")
    last = [F.col("_last")] if fallback else []
    return out.select(
        *future.columns, F.coalesce(F.col("_y"), *last, F.lit(0.0)).alias("y_pred")
    )


def naive_oof(
    panel: DataFrame, folds: Sequence[Fold], *, periods: Sequence[int] = (7,), with_last: bool = True,
    fallback: bool = True, entity_cols: Sequence[str] = ENTITY, date_col: str = "date",
    target_col: str = "sales",
) -> DataFrame:
    """Out-of-fold forecasts of every naive method for every fold.

    One row per entity, fold and validation date with ``y_true``, ``last_value`` and one
    ``seasonal_naive_<p>`` per period.  State per entity is bounded by
    ``folds x (longest period + horizon)`` days, whatever the length of the history.
    """
    keys = list(entity_cols)
    date, y = F.col("_d"), F.col("_y")
    reach = max(periods, default=0)
    aggs = []
    for f in folds:
        origin = F.lit(f.train_end)
        recent = (date <= origin) & (date > F.date_sub(origin, reach))
        ahead = date.between(f.val_start, f.val_end)
        aggs.append(
            F.struct(
                F.lit(f.fold).alias("fold"),
                origin.alias("origin"),
                _last_known(y, date, origin).alias("last"),
                F.map_from_entries(
                    F.collect_list(F.when(recent, F.struct(date, y)))
                ).alias("recent"),
                F.collect_list(
                    F.when(ahead, F.struct(date.alias("date"), y.alias("y_true")))
                ).alias("ahead"),
            ).alias(f"_f{f.fold}")
        )
    # Rows after the last fold play no part.  Days before every lookup only matter for the last
    # known value: a plain hash aggregate folds them into one row per entity, so the list
    # aggregate sees a few weeks of rows however long the history is.
    raw_date, raw_y = F.col(date_col), F.col(target_col).cast("double")
    first_used = F.date_sub(F.lit(min(f.train_end for f in folds)), reach)
    compact = (
        panel.where(raw_date <= F.lit(max(f.val_end for f in folds)))
        .groupBy(*keys, F.when(raw_date > first_used, raw_date).alias("_day"))
        .agg(
            F.max_by(raw_y, F.when(raw_y.isNotNull(), raw_date)).alias("_y"),
            F.max(F.when(raw_y.isNotNull(), raw_date)).alias("_seen"),
        )
        .select(*keys, F.coalesce("_day", "_seen").alias("_d"), "_y")
    )
    state = compact.groupBy(*keys).agg(*aggs)
    per_fold = state.select(
        *keys, F.explode(F.array(*[F.col(f"_f{f.fold}") for f in folds])).alias("s")
    )
    rows = per_fold.select(
        *keys, F.col("s.fold").alias("fold"), F.col("s.origin").alias("_origin"),
        F.col("s.last").alias("_last"), F.col("s.recent").alias("_recent"),
        F.explode("s.ahead").alias("a"),
    )
    day = F.col("a.date")

    def seasonal(p: int) -> Column:
        found = F.try_element_at("_recent", F.date_sub(day, seasonal_steps(day, F.col("_origin"), p) * p))
        tail = [F.col("_last")] if fallback else []
        return F.coalesce(found, *tail, F.lit(0.0)).alias(f"seasonal_naive_{p}")

    methods = [F.coalesce("_last", F.lit(0.0)).alias("last_value")] if with_last else []
    return rows.select(
        *keys, day.alias(date_col), "fold", F.col("a.y_true").alias("y_true"),
        *methods, *[seasonal(p) for p in periods],
    )


def to_long(oof: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per forecast method: ``method, y_pred`` beside the keys."""
    keys = [c for c in oof.columns if c not in methods]
    return oof.unpivot(keys, list(methods), "method", "y_pred")
