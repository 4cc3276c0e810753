"""Walk-forward training and scoring jobs."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.scalars import transform_target
from tidepanel.operators import growth, linear, trees
from tidepanel.operators.evaluation import fold_metrics, summarize_folds
from tidepanel.operators.features import ablation_group_sets, build_feature_matrix, category_columns, model_columns, needs_recursion
from tidepanel.operators.naive import naive_oof, to_long
from tidepanel.operators.panel import fold_matrix, horizon_matrix, training_matrix
from tidepanel.operators.recursive import forecast_transformer, history_for, origin_state
from tidepanel.operators.splits import Fold, holdout_flags, holdout_usable
from tidepanel.operators.target_stats import ordered_statistics, origin_statistics, stat_name
from tidepanel.session import saved
from tidepanel.sources.runs import finished_runs, run_inventory, save_oof, save_run
from tidepanel.sources.schemas import ENTITY

_writing = threading.Lock()
OOF_COLUMNS = (*ENTITY, "date", "fold", "y_true", "y_pred")


def score_baseline(panel: DataFrame, folds: Sequence[Fold], name: str = "seasonal_naive", period: int = 7) -> DataFrame:
    """OOF of one naive method over all folds, in one job."""
    if name == "last_value":
        wide, col = naive_oof(panel, folds, periods=()), "last_value"
    elif name == "seasonal_naive":
        wide, col = naive_oof(panel, folds, periods=(period,), with_last=False), f"seasonal_naive_{period}"
    else:
        raise ValueError(f"unknown baseline {name!r}")
    return wide.withColumnRenamed(col, "y_pred").select(*OOF_COLUMNS)


def baseline_metrics(panel: DataFrame, folds: Sequence[Fold], periods: Sequence[int] = (7, 14)) -> DataFrame:
    """All naive methods scored together: one pass over the panel."""
    wide = naive_oof(panel, folds, periods=periods)
    methods = ["last_value", *[f"seasonal_naive_{p}" for p in periods]]
    return fold_metrics(to_long(wide, methods), by=["method"])


def in_threads(spark: SparkSession, fn: Callable, items: Iterable, most: int = 4) -> Iterator:
    """Results of ``fn`` for each item, in order, from a few driver threads.

    Each thread's jobs go to a scheduler pool of their own, which shares the executors fairly where
    the session runs in FAIR mode.
    """

    def run(pair):
        i, item = pair
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % most}")
        return fn(item)

    with ThreadPoolExecutor(most) as pool:
        yield from pool.map(inheritable_thread_target(spark)(run), enumerate(items))


def model_matrix(panel: DataFrame, *, groups: Sequence[str], extras: Mapping[str, DataFrame] | None = None,
                 target_transform: str | None = "log1p", **build) -> DataFrame:
    """Training rows with model inputs and category levels, stored once.

    Every feature looks strictly back, the statistics of categories too: one matrix serves all
    folds, trials and seeds, cut by date.
    """
    rows = training_matrix(panel, groups=groups, extras=extras, **build)
    cats = category_columns(groups)
    made = ordered_statistics(rows, cats, transform_target("y_true", target_transform))
    return saved(made.select(*dict.fromkeys([*ENTITY, "date", *cats, *model_columns(groups)]), "y_true"), "matrix")


def with_origin_statistics(
    rows: DataFrame, panel: DataFrame, origin, *, groups: Sequence[str], extras: Mapping[str, DataFrame] | None = None,
    target_transform: str | None = "log1p",
) -> DataFrame:
    """Horizon rows with the statistics of their categories at the origin."""
    cats = category_columns(groups)
    past = panel.where(F.col("date") <= F.lit(origin))
    if set(cats) - set(past.columns):
        past = build_feature_matrix(past, groups=["store_meta"], extras=extras)
    return origin_statistics(rows, past, cats, transform_target("sales", target_transform))


def fitted_rows(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows a model is fitted on: those with a target.

    Rows of the first day are left out where category statistics are used: nothing lies before them,
    so their statistics say nothing, and missing lags would be fitted to make up for it.
    """
    known = matrix.where(F.col("y_true").isNotNull())
    if any(c.endswith(stat_name("")) for c in cols):
        known = known.where(F.col("date") > matrix.agg(F.min("date")).scalar())
    return known


class Packed(NamedTuple):
    """A matrix packed for boosted trees (``growth``): its rows, their encoder, blocks and bin limits."""

    rows: DataFrame
    encoder: PipelineModel
    blocks: DataFrame
    cuts: list
    bins: int


def pack_matrix(matrix: DataFrame, cols: Sequence[str], target_transform: str | None = "log1p", bins: int = 128) -> Packed:
    """The matrix as blocks of bin numbers, stored once for all boosted models of all folds, trials and seeds."""
    known = fitted_rows(matrix, cols)
    encoder = trees.fit_encoder(known, cols, "gbt")
    slots = trees.slot_columns(encoder)
    made = trees.with_inputs(
        known, cols, F.unix_date("date").alias("_day"), transform_target("y_true", target_transform).alias("label"),
        F.xxhash64(*ENTITY, "date").alias("_mark"), wanted=trees.input_names(encoder))
    cuts = growth.cut_points(made, slots, bins)
    return Packed(known, encoder, growth.pack(made, slots, cuts), cuts, bins)


def bins_together(family: str, *params: Mapping[str, object] | None) -> int | None:
    """Bins of a packed matrix that serves all these models; None where it can't, and each is fitted by itself."""
    if family != "gbt":
        return None
    bins = {int(trees.spark_params(p or {}, family)["maxBins"]) for p in params}
    return bins.pop() if len(bins) == 1 and max(bins) <= growth.MOST_BINS else None


class Wanted(NamedTuple):
    """One boosted model to be fitted on a packed matrix up to an origin; ``slots`` None: all."""

    train_end: object
    params: Mapping[str, object]
    seed: int = 42
    slots: Sequence[int] | None = None


def fit_packed(
    packed: Packed, wanted: Sequence[Wanted], *, patience: int | None = None, holdout_days: int = 15, min_fit: int = 1000,
    min_holdout: int = 100,
) -> list[tuple[PipelineModel, dict]]:
    """Boosted models fitted in the same passes, with the notes of ``fit_encoded_fold``.

    With patience the last days up to an origin are held out; too few rows on either side raise.
    """
    if patience:
        for end in {w.train_end for w in wanted}:
            if not holdout_usable(holdout_flags(packed.rows, end, days=holdout_days), min_fit, min_holdout):
                raise ValueError("the holdout is too small to stop on, and there are no other rows to stop on")
    slots = tuple(range(len(packed.cuts)))
    jobs = []
    for w in wanted:
        until = (w.train_end - dt.date(1970, 1, 1)).days
        jobs.append(growth.Job(
            until, trees.spark_params(w.params, "gbt"), w.seed, slots if w.slots is None else tuple(w.slots),
            until - holdout_days + 1 if patience else None, patience))
    return [
        (PipelineModel(stages=[*packed.encoder.stages, model]), {**info, "stopped_on": "holdout" if patience else None})
        for model, info in growth.grow(packed.blocks, packed.cuts, jobs)
    ]


def encode_matrix(matrix: DataFrame, cols: Sequence[str], family: str, target_transform: str | None = "log1p"):
    """Encoder and encoded rows (keys, date, y_true, label, features).

    They are stored once for fits that read them many times. A linear fit reads its rows once, so for it
    they are encoded as they are read, and the wide vectors never reach the disk.
    """
    known = fitted_rows(matrix, cols)
    encoder = trees.fit_encoder(known, cols, family)
    label = transform_target("y_true", target_transform).alias("label")
    vectors = trees.encoded(known, cols, encoder, *ENTITY, "date", "y_true", label)
    return encoder, vectors if family == "linear" else saved(vectors, "vectors")


def fit_linear_folds(
    matrix: DataFrame, cols: Sequence[str], ends: Sequence, params: Mapping[str, object] | None = None, target_transform: str | None = "log1p",
) -> list[tuple[PipelineModel, dict]]:
    """Linear models up to each origin, with the notes of ``fit_encoded_fold``; the rows are read once for all of them."""
    known = fitted_rows(matrix, cols)
    encoder = trees.fit_encoder(known, cols, "linear")
    made = known.select(*cols, F.unix_date("date").alias("_day"), transform_target("y_true", target_transform).alias("label"))
    given = trees.spark_params(params or {}, "linear")
    models = linear.fit_linear(made, trees.slot_columns(encoder), ends, given)
    notes = {"best_iteration": None, "fitted_rounds": given.get("maxIter"), "params": given, "stopped_on": None}
    return [(PipelineModel(stages=[*encoder.stages, m]), dict(notes)) for m in models]


def fit_encoded_fold(
    vectors: DataFrame, encoder: PipelineModel, train_end, *, family: str = "gbt", params: Mapping[str, object] | None = None,
    seed: int = 42, patience: int | None = None, holdout_days: int = 15, min_fit: int = 1000, min_holdout: int = 100,
    fallback: Callable[[], DataFrame] | None = None,
) -> tuple[PipelineModel, dict]:
    """Fit on encoded rows up to the origin.

    With patience, the last days are held out to stop on. If either side has too few rows, the fit
    stops on ``fallback()`` (encoded validation rows) and uses all rows; without one it raises.
    """
    rows = holdout_flags(vectors, train_end, days=holdout_days)
    held, source = None, None
    if patience:
        if holdout_usable(rows, min_fit, min_holdout):
            held, source = rows.where("is_holdout"), "holdout"
            rows = rows.where(~F.col("is_holdout"))
        elif fallback is not None:
            held, source = fallback(), "validation"
        else:
            raise ValueError("the holdout is too small to stop on, and there are no other rows to stop on")
    model, info = trees.fit_encoded(rows, encoder, family=family, params=params, seed=seed, held=held, patience=patience)
    return model, {**info, "stopped_on": source}


def fit_fold(
    matrix: DataFrame, train_end, cols: Sequence[str], *, family: str = "gbt", target_transform: str | None = "log1p", **fit,
) -> tuple[PipelineModel, dict]:
    """Encode a matrix and fit one fold of it (``fit_packed`` for boosted trees, else ``fit_encoded_fold``)."""
    inside = matrix.where(F.col("date") <= F.lit(train_end))
    bins = bins_together(family, fit.get("params"))
    if bins and fit.get("fallback") is None:
        more = {k: v for k, v in fit.items() if k not in ("params", "seed", "fallback")}
        wanted = Wanted(train_end, fit.get("params") or {}, fit.get("seed", 42))
        return fit_packed(pack_matrix(inside, cols, target_transform, bins), [wanted], **more)[0]
    if family == "linear" and not fit.get("patience") and not trees.text_features(matrix, cols):
        return fit_linear_folds(inside, cols, [train_end], fit.get("params"), target_transform)[0]
    encoder, vectors = encode_matrix(inside, cols, family, target_transform)
    return fit_encoded_fold(vectors, encoder, train_end, family=family, **fit)


def forecast_fold(
    panel: DataFrame, fold: Fold, models: Sequence[PipelineModel], *, groups: Sequence[str],
    extras: Mapping[str, DataFrame] | None = None, target_transform: str = "log1p",
    clip_negative: bool = True, keep: Sequence[str] = (), **build,
) -> DataFrame:
    """Forecast one fold's horizon: recursively if a feature depends on the target, else directly."""
    cols = model_columns(groups)
    history = history_for(cols)
    rows = horizon_matrix(panel, fold, groups=groups, extras=extras, history=history, **build)
    rows = with_origin_statistics(rows, panel, fold.train_end, groups=groups, extras=extras, target_transform=target_transform)
    if not needs_recursion(groups):
        val = rows.where(F.col("date").between(fold.val_start, fold.val_end)).withColumns(
            {"y_true": F.col("sales"), "fold": F.lit(fold.fold)}
        )
        out = [
            trees.predict(val, m, cols, target_transform=target_transform, clip_negative=clip_negative)
            for m in models
        ]
        keys = [*ENTITY, "date", "fold", "y_true", *keep]
        if len(out) == 1:
            return out[0].select(*keys, "y_pred")
        union = reduce(DataFrame.unionByName, [o.select(*keys, "y_pred") for o in out])
        return union.groupBy(*keys).agg(F.avg("y_pred").alias("y_pred"))
    known = [c for c in cols if c in rows.columns and c not in ENTITY]
    state = origin_state(rows, [fold], known, history=history, keep=keep)
    horizon = (fold.val_end - fold.val_start).days + 1
    out = forecast_transformer(
        state, models, cols, horizon, target_transform=target_transform, clip_negative=clip_negative
    )
    return out.select(*ENTITY, "date", "fold", "y_true", *keep, "y_pred")


def score_trees(
    panel: DataFrame, folds: Sequence[Fold], *, groups: Sequence[str],
    extras: Mapping[str, DataFrame] | None = None, matrix: DataFrame | None = None, packed: Packed | None = None,
    models_dir: str | None = None, fit: Mapping[str, object] | None = None, threads: int = 4, **build,
) -> tuple[DataFrame, list[PipelineModel], list[dict]]:
    """Fit and forecast each fold; returns the OOF table, the models and the fit notes.

    The matrix is built and encoded once and cut by date for every fold. Boosted trees of all folds
    grow in the same passes, on ``packed`` if that is given; other folds are fitted from a few driver threads.
    """
    fit = dict(fit or {})
    cols, transform = model_columns(groups), fit.pop("target_transform", "log1p")
    if matrix is None and packed is None:
        matrix = model_matrix(panel, groups=groups, extras=extras, target_transform=transform, **build)
    family, patience = fit.get("family", "gbt"), fit.get("patience")
    limits = {k: fit[k] for k in ("holdout_days", "min_fit", "min_holdout") if k in fit}
    bins = bins_together(family, fit.get("params"))
    rows = packed.rows if packed is not None else fitted_rows(matrix, cols)
    sides = {"days": limits.get("holdout_days", 15)}
    enough = not patience or all(
        holdout_usable(holdout_flags(rows, f.train_end, **sides), limits.get("min_fit", 1000), limits.get("min_holdout", 100)) for f in folds)
    together = bins is not None and enough
    if packed is not None and not (together and packed.bins == bins):
        raise ValueError("a packed matrix serves boosted trees of its bins that need no other rows to stop on")
    if together and packed is None:
        packed = pack_matrix(matrix, cols, transform, bins)
    # Text levels are indexed by a stage that the products can't look into; none of the feature groups has any.
    numbers = family == "linear" and not patience and not trees.text_features(matrix, cols)
    if not together and not numbers:
        encoder, vectors = encode_matrix(matrix, cols, family, transform)

    def masked_validation(fold: Fold) -> Callable[[], DataFrame]:
        def rows() -> DataFrame:
            val = fold_matrix(panel, fold, groups=groups, extras=extras, **build).where("role = 'val' and y_true is not null")
            val = with_origin_statistics(val, panel, fold.train_end, groups=groups, extras=extras, target_transform=transform)
            return trees.encoded(val, cols, encoder, transform_target("y_true", transform).alias("label"))

        return rows

    def one(fold: Fold):
        return fit_encoded_fold(vectors, encoder, fold.train_end, fallback=masked_validation(fold), **fit)

    if together:
        wanted = [Wanted(f.train_end, fit.get("params") or {}, fit.get("seed", 42)) for f in folds]
        fitted = fit_packed(packed, wanted, patience=patience, **limits)
    elif numbers:
        fitted = fit_linear_folds(matrix, cols, [f.train_end for f in folds], fit.get("params"), transform)
    else:
        fitted = list(in_threads(panel.sparkSession, one, folds, threads))
    models = [m for m, _ in fitted]
    notes = [{"fold": f.fold, **info} for f, (_, info) in zip(folds, fitted)]

    def forecast(pair: tuple[Fold, PipelineModel]) -> DataFrame:
        return forecast_fold(panel, pair[0], [pair[1]], groups=groups, extras=extras, target_transform=transform, **build)

    parts = list(in_threads(panel.sparkSession, forecast, zip(folds, models), threads))
    if models_dir:
        trees.save_fold_models(models, models_dir)
    return reduce(DataFrame.unionByName, parts).select(*OOF_COLUMNS), models, notes


def run_experiment(
    panel: DataFrame, folds: Sequence[Fold], outputs: str, spec: Mapping[str, object],
    extras: Mapping[str, DataFrame] | None = None, matrix: DataFrame | None = None, packed: Packed | None = None, **build,
) -> DataFrame:
    """One run by specification (naive or fitted): OOF and metrics stored under its id."""
    run_id, kind = spec["run_id"], spec.get("model", "seasonal_naive")
    if kind in ("last_value", "seasonal_naive"):
        oof = score_baseline(panel, folds, kind, int(spec.get("period", 7)))
    else:
        fit = {k: spec[k] for k in ("params", "seed", "patience", "target_transform") if k in spec}
        oof, _, _ = score_trees(
            panel, folds, groups=spec["groups"], extras=extras, matrix=matrix, packed=packed, fit={"family": kind, **fit}, **build
        )
    oof = saved(oof, "oof")
    # Runs of other threads write to the same folders; Spark's commit takes one writer of a folder at a time.
    with _writing:
        save_oof(oof, f"{outputs}/oof", run_id)
        stored = panel.sparkSession.read.parquet(f"{outputs}/oof").where(F.col("run_id") == run_id)
    summary = summarize_folds(fold_metrics(stored))
    with _writing:
        save_run(summary, f"{outputs}/metrics", run_id, config=spec, seed=spec.get("seed"))
    return summary.withColumn("run_id", F.lit(run_id))


def run_matrix(
    panel: DataFrame, folds: Sequence[Fold], outputs: str, specs: Sequence[Mapping[str, object]], *, runs_at_once: int = 4, **kw
) -> DataFrame:
    """Several runs (seeds, ablation steps) from a few driver threads; finished ones are reused.  Returns the inventory."""
    spark = panel.sparkSession
    done = finished_runs(spark, f"{outputs}/metrics")
    have = {r["run_id"] for r in done.select("run_id").collect()} if done is not None else set()
    todo = [s for s in specs if s["run_id"] not in have]
    list(in_threads(spark, lambda spec: run_experiment(panel, folds, outputs, spec, **kw), todo, runs_at_once))
    wanted = [s["run_id"] for s in specs]
    return run_inventory(spark, f"{outputs}/metrics").where(F.col("run_id").isin(*wanted))


def seed_specs(base: Mapping[str, object], seeds: Sequence[int]) -> list[dict]:
    return [{**base, "run_id": f"{base['run_id']}_seed{s}", "seed": s} for s in seeds]


# Run numbers and names of the experiment plan.
NAIVE_RUNS = (
    {"run_id": "000_last_value", "model": "last_value"},
    {"run_id": "001_seasonal_naive_7", "model": "seasonal_naive", "period": 7},
    {"run_id": "002_seasonal_naive_14", "model": "seasonal_naive", "period": 14},
)


def ablation_specs(model: str = "gbt", first: int = 10, **fit) -> list[dict]:
    """The progressive feature-group runs, numbered in order."""
    return [
        {"run_id": f"{first + i:03d}_{model}_plus_{groups[-1]}", "model": model, "groups": groups, **fit}
        for i, groups in enumerate(ablation_group_sets())
    ]
