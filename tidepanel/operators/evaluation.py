"""Scoring of out-of-fold forecasts by fold, horizon and segment, and the naive gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.metrics import score_columns
from tidepanel.functions.scalars import is_payday
from tidepanel.operators.splits import Fold
from tidepanel.sources.schemas import require_columns

# Fixed value: mean RMSLE of the seasonal-naive-7 baseline on the original data.
NAIVE_FLOOR = 0.5513


def annotate_horizon(oof: DataFrame, folds: Sequence[Fold], *, date_col: str = "date", fold_col: str = "fold") -> DataFrame:
    """1-based day inside the fold's validation window; fold starts are literals."""
    start: Column | None = None
    for f in folds:
        hit = F.col(fold_col) == f.fold
        start = F.when(hit, F.lit(f.val_start)) if start is None else start.when(hit, F.lit(f.val_start))
    return oof.withColumn("horizon", F.datediff(F.col(date_col), start) + 1)


def annotate_payday(oof: DataFrame, *, date_col: str = "date") -> DataFrame:
    return oof.withColumn("is_payday", is_payday(date_col))


def annotate_zero_target(oof: DataFrame, *, target_col: str = "y_true") -> DataFrame:
    return oof.withColumn("is_zero", (F.col(target_col) <= 0).cast("int"))


def with_slices(oof: DataFrame, folds: Sequence[Fold], stores: DataFrame | None = None) -> DataFrame:
    """Horizon, payday, zero flag and store attributes beside each forecast row."""
    out = annotate_zero_target(annotate_payday(annotate_horizon(oof, folds)))
    if stores is not None:
        meta = stores.select("store_nbr", "city", "state", F.col("type").alias("store_type"), "cluster")
        out = out.join(meta, "store_nbr", "left")
    return out


def fold_metrics(oof: DataFrame, *, by: Sequence[str] = (), fold_col: str = "fold", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-fold scores plus the pooled row (fold NULL) from one pass of grouping sets."""
    sets = [[*by, fold_col], [*by]]
    return oof.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*by, fold_col)]
    ).agg(*score_columns(y_true, y_pred))


def summarize_folds(per_fold: DataFrame, *, by: Sequence[str] = (), fold_col: str = "fold") -> DataFrame:
    """Mean and sample deviation over folds beside the pooled scores."""
    one, pooled = F.col(fold_col).isNotNull(), F.col(fold_col).isNull()

    def over_folds(fn, c):
        return fn(F.when(one, F.col(c)))

    def pool(c):
        return F.max(F.when(pooled, F.col(c)))

    return per_fold.groupBy(*by).agg(
        over_folds(F.avg, "rmsle").alias("mean_rmsle"),
        F.coalesce(over_folds(F.stddev_samp, "rmsle"), F.lit(0.0)).alias("std_rmsle"),
        over_folds(F.avg, "mae_log1p").alias("mean_mae_log1p"),
        over_folds(F.avg, "bias_log1p").alias("mean_bias_log1p"),
        pool("rmsle").alias("pooled_oof_rmsle"),
        pool("mae_log1p").alias("pooled_oof_mae_log1p"),
        pool("bias_log1p").alias("pooled_oof_bias_log1p"),
        pool("n").alias("n_oof"),
        F.count_if(one).alias("n_folds"),
    )


def horizon_metrics(oof: DataFrame, *, horizon_col: str = "horizon", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    require_columns(oof, [horizon_col], "forecast table (annotate the horizon first)")
    return oof.groupBy(F.col(horizon_col).alias("horizon")).agg(*score_columns(y_true, y_pred))


def segment_table(
    oof: DataFrame, segment_cols: Sequence[str], *, min_n: int = 1, y_true: str = "y_true",
    y_pred: str = "y_pred", with_mean_y: bool = False,
) -> DataFrame:
    """Long table over several segment columns from one pass; segments below ``min_n`` rows drop out.

    Rows with a NULL segment value are left out.  Map-side aggregation reduces the exploded
    rows to one per segment value and task before anything is shuffled.
    """
    require_columns(oof, segment_cols, "forecast table")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("segment_type"), F.col(c).cast("string").alias("segment")) for c in segment_cols]
    )
    extra = [F.avg(y_true).alias("mean_y")] if with_mean_y else []
    return (
        oof.select(y_true, y_pred, F.explode(pairs).alias("s"))
        .where(F.col("s.segment").isNotNull())
        .groupBy(F.col("s.segment_type").alias("segment_type"), F.col("s.segment").alias("segment"))
        .agg(*score_columns(y_true, y_pred), *extra)
        .where(F.col("n") >= min_n)
    )


def segment_metrics(oof: DataFrame, *, by: str, min_n: int = 1, **cols) -> DataFrame:
    """One segment column, worst first."""
    return segment_table(oof, [by], min_n=min_n, **cols).orderBy(F.desc("rmsle"), "segment")


def gate_vs_naive(summary: DataFrame, *, floor: float | Column = NAIVE_FLOOR) -> DataFrame:
    """Go or no-go of a fold summary against the naive floor."""
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    beats = F.col("mean_rmsle") < floor
    return summary.withColumns({
        "naive_floor_rmsle": floor,
        "beats_naive_floor": beats,
        "delta_vs_naive_rmsle": F.col("mean_rmsle") - floor,
        "go_no_go": F.when(beats, "GO").otherwise("NO_GO"),
    })


def seed_summary(runs: DataFrame, seeds: Sequence[int], *, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, deviation, best and worst over seeds, with one column per seed."""
    return runs.groupBy(*by).agg(
        F.avg("mean_rmsle").alias("seeds_mean"),
        F.coalesce(F.stddev_samp("mean_rmsle"), F.lit(0.0)).alias("seeds_std"),
        F.max("mean_rmsle").alias("seeds_worst"),
        F.min("mean_rmsle").alias("seeds_best"),
        *[F.max(F.when(F.col("seed") == s, F.col("mean_rmsle"))).alias(f"seed_{s}") for s in seeds],
    )


def scoreboard(runs: DataFrame, *, baseline: str) -> DataFrame:
    """Each run against the baseline run's mean score."""
    # The window spans the run table: one row per run.
    is_base = F.col("run_id") == baseline
    floor = F.min(F.when(is_base, F.col("mean_rmsle"))).over(Window.partitionBy())
    return runs.select(
        "run_id", "mean_rmsle", (F.col("mean_rmsle") < floor).alias("beats_baseline"),
        (F.col("mean_rmsle") - floor).alias("delta_vs_baseline"),
    )


def group_importance(gains: DataFrame, membership: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sum member gains per feature group and fold, then average over folds."""
    pairs = [(c, g) for g, cols in membership.items() for c in cols]
    lookup = F.create_map(*[F.lit(x) for pair in {c: g for c, g in reversed(pairs)}.items() for x in pair])
    return (
        gains.withColumn("feature_group", F.coalesce(F.try_element_at(lookup, F.col("feature")), F.lit("other")))
        .groupBy("feature_group", "fold").agg(F.sum("gain").alias("gain"))
        .groupBy("feature_group").agg(F.avg("gain").alias("mean_gain"))
    )
