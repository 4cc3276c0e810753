"""Recursive multi-step forecasting on array state.

Every entity needs only its own last rows, so history is folded into one array per entity
(and fold) by a single shuffle.  Each forecast step is then a narrow projection: lags are
elements from the array's end, rolling statistics are folds over its tail, and the new value
is appended.  Nothing is shuffled per step.

* ``forecast_column``: the model is a Column expression; all steps run inside one
  ``aggregate`` call in one stage, for every fold at once.
* ``forecast_transformer``: the model is a fitted Spark ML transformer; the steps are
  chained projections, with a reliable checkpoint every few steps.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.scalars import inverse_target, nonnegative
from tidepanel.operators.features import DEFAULT_LAGS, DEFAULT_WINDOWS
from tidepanel.operators.splits import Fold
from tidepanel.operators.trees import input_names, model_inputs
from tidepanel.session import cut_lineage
from tidepanel.sources.schemas import ENTITY

HISTORY = max(*DEFAULT_LAGS, *DEFAULT_WINDOWS)


def history_for(names: Sequence[str], target: str = "sales") -> int:
    """Past values that the lag and rolling columns among ``names`` look at."""
    heads = (f"{target}_lag", f"{target}_roll_mean", f"{target}_roll_std")
    return max([1, *(int(n.rpartition("_")[2]) for n in names if n.rpartition("_")[0] in heads)])


def origin_state(
    panel: DataFrame, folds: Sequence[Fold], covariates: Sequence[str] = (), *,
    entity_cols: Sequence[str] = ENTITY, date_col: str = "date", target_col: str = "sales",
    history: int = HISTORY, keep: Sequence[str] = (),
) -> DataFrame:
    """One row per entity and fold: ``hist`` (last rows up to the origin) and ``fut`` (horizon).

    ``hist`` is padded in front with NULLs to exactly ``history`` values.  ``fut`` holds date,
    true target and known covariates, ordered by date.  Both are bounded: ``history`` rows,
    however many days they span, and the horizon.  ``history_for`` gives the length that a set of
    features needs.  ``keep`` names extra columns carried in ``fut``.
    """
    keys, date = list(entity_cols), F.col(date_col)
    cov = F.struct(
        date.alias("date"), F.col(target_col).cast("double").alias("y_true"),
        *[F.col(c).alias(c) for c in dict.fromkeys([*covariates, *keep])],
    )
    past = F.struct(date.alias("date"), F.col(target_col).cast("double").alias("y"))

    def one(f: Fold) -> Column:
        origin = F.lit(f.train_end)
        recent = (date <= origin) & (F.col(f"_back{f.fold}") <= history)
        return F.struct(
            F.lit(f.fold).alias("fold"),
            F.array_sort(F.collect_list(F.when(recent, past))).alias("past"),
            F.array_sort(
                F.collect_list(F.when(date.between(f.val_start, f.val_end), cov))
            ).alias("fut"),
        ).alias(f"_f{f.fold}")

    hi = max(f.val_end for f in folds)
    back = Window.partitionBy(*keys).orderBy(F.desc(date_col)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = panel.where(date <= F.lit(hi)).withColumns({f"_back{f.fold}": F.count_if(date <= F.lit(f.train_end)).over(back) for f in folds})
    needed = [(F.col(f"_back{f.fold}") <= history) & (date <= F.lit(f.val_end)) for f in folds]
    used = ranked.where(reduce(operator.or_, needed))
    state = used.groupBy(*keys).agg(*[one(f) for f in folds])
    rows = state.select(*keys, F.explode(F.array(*[F.col(f"_f{f.fold}") for f in folds])).alias("s"))
    padded = F.concat(
        F.array_repeat(F.lit(None).cast("double"), history),
        F.transform("s.past", lambda r: r["y"]),
    )
    return rows.where(F.size("s.fut") > 0).select(
        *keys, F.col("s.fold").alias("fold"),
        F.slice(padded, -history, history).alias("hist"), F.col("s.fut").alias("fut"),
    )


def lag_of(hist: Column, k: int) -> Column:
    return F.try_element_at(hist, F.lit(-k))


def mean_of(hist: Column, w: int) -> Column:
    """Mean of the last ``w`` values, NULLs skipped; NULL when all are missing."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def add(acc, x):
        return F.when(x.isNull(), acc).otherwise(
            F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n"))
        )

    return F.aggregate(
        F.slice(hist, -w, w), zero, add, lambda a: F.when(a["n"] > 0, a["s"] / a["n"])
    )


def std_of(hist: Column, w: int) -> Column:
    """Sample deviation of the last ``w`` values by running mean and centred squares."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def add(acc, x):
        m = acc["m"] + (x - acc["m"]) / (acc["n"] + 1)
        return F.when(x.isNull(), acc).otherwise(
            F.struct(
                (acc["n"] + 1).alias("n"), m.alias("m"),
                (acc["q"] + (x - acc["m"]) * (x - m)).alias("q"),
            )
        )

    return F.aggregate(
        F.slice(hist, -w, w), zero, add,
        lambda a: F.when(a["n"] > 1, F.sqrt(a["q"] / (a["n"] - 1))),
    )


def recursive_features(
    hist: Column, names: Sequence[str], target: str = "sales"
) -> dict[str, Column]:
    """The lag and rolling columns among ``names``, computed from the state array."""
    out = {}
    for name in names:
        head, _, number = name.rpartition("_")
        if head == f"{target}_lag":
            out[name] = lag_of(hist, int(number))
        elif head == f"{target}_roll_mean":
            out[name] = mean_of(hist, int(number))
        elif head == f"{target}_roll_std":
            out[name] = std_of(hist, int(number))
    return out


def linear_model(weights: Mapping[str, float], intercept: float = 0.0) -> Callable[[Mapping[str, Column]], Column]:
    """Column model ``intercept + sum w*x`` with missing inputs counted as zero."""

    def score(x: Mapping[str, Column]) -> Column:
        total = F.lit(float(intercept))
        for name, w in weights.items():
            total = total + F.lit(float(w)) * F.coalesce(x[name].cast("double"), F.lit(0.0))
        return total

    return score


def forecast_column(
    state: DataFrame, model: Callable[[Mapping[str, Column]], Column], feature_cols: Sequence[str], *,
    target_transform: str = "identity", clip_negative: bool = True, date_col: str = "date",
) -> DataFrame:
    """Forecast all horizon days with a Column model, inside one projection."""

    varying = {f.name for f in state.schema["fut"].dataType.elementType}

    def step(acc: Column, row: Column) -> Column:
        made = recursive_features(acc, feature_cols)
        x = {c: made[c] if c in made else row[c] if c in varying else F.col(c) for c in feature_cols}
        pred = nonnegative(inverse_target(model(x), target_transform), clip_negative)
        return F.concat(acc, F.array(pred))

    grown = F.aggregate("fut", F.col("hist"), step)
    preds = F.slice(grown, F.size("hist") + 1, F.size("fut"))
    return explode_forecast(state.withColumn("preds", preds), date_col=date_col)


def explode_forecast(state: DataFrame, pred_cols: Sequence[str] = ("preds",), *, date_col: str = "date") -> DataFrame:
    """Back to one row per forecast day."""
    keys = [c for c in state.columns if c not in ("fut", *pred_cols) and not c.startswith("hist")]
    names = {p: "y_pred" if p == "preds" else f"y_pred_{p.removeprefix('preds_')}" for p in pred_cols}
    rows = state.select(
        *keys, F.explode(F.arrays_zip(F.col("fut").alias("fut"), *[F.col(p).alias(p) for p in pred_cols])).alias("r")
    )
    carried = [f.name for f in state.schema["fut"].dataType.elementType if f.name != "date"]
    return rows.select(
        *keys, F.col("r.fut.date").alias(date_col),
        *[F.col(f"r.fut.{c}").alias(c) for c in carried],
        *[F.col(f"r.{p}").alias(n) for p, n in names.items()],
    )


def forecast_transformer(
    state: DataFrame, models: Sequence[PipelineModel], feature_cols: Sequence[str], horizon: int, *,
    target_transform: str = "log1p", clip_negative: bool = True,
    checkpoint_every: int = 4, date_col: str = "date",
) -> DataFrame:
    """Forecast with fitted pipelines, each recursing on its own predictions.

    All members advance together, one history array each; ``y_pred`` is their mean and
    ``y_pred_<i>`` the members.  ``horizon`` is the longest horizon of any entity.  Columns of
    the state (entity keys) are inputs too; text levels go through the pipeline's indexer.
    """
    fut = {f.name: f.dataType for f in state.schema["fut"].dataType.elementType}
    own = {f.name: f.dataType for f in state.schema}
    kinds = {**fut, **own}
    text = [c for c in feature_cols if isinstance(kinds.get(c), T.StringType)]
    members = range(len(models))
    work = state.select(
        F.lit(1).alias("_h"), *[c for c in state.columns if c != "hist"],
        *[F.col("hist").alias(f"hist_{i}") for i in members],
        *[F.array().cast("array<double>").alias(f"preds_{i}") for i in members],
    )
    kept = list(work.columns)
    # The step number is a column, so every expression is built once and serves all steps.
    # Features are named in one projection and used in the next, to be evaluated once.
    row = F.try_element_at("fut", F.col("_h"))
    active = F.size("fut") >= F.col("_h")
    value = nonnegative(inverse_target(F.col("prediction"), target_transform), clip_negative)
    pred = F.array(F.when(active, value))
    wanted = set().union(*map(input_names, models))
    inputs = model_inputs({c: F.col(c) for c in feature_cols}, text, wanted)
    plans = []
    for i, model in enumerate(models):
        hist, preds = F.col(f"hist_{i}"), F.col(f"preds_{i}")
        made = recursive_features(hist, feature_cols)
        features = [(made[c] if c in made else row[c]).alias(c) for c in feature_cols if c not in own]
        after = {
            f"hist_{i}": F.concat(F.slice(hist, 2, F.size(hist) - 1), pred),
            f"preds_{i}": F.concat(preds, pred),
        }
        if i == len(models) - 1:
            after["_h"] = F.col("_h") + 1
        update = [after[c].alias(c) if c in after else F.col(c) for c in kept]
        plans.append((model, features, update))
    # Plans grow by one scoring per member and step; `checkpoint_every` scorings end a plan.
    every = max(1, checkpoint_every // len(models))
    for h in range(1, horizon + 1):
        for model, features, update in plans:
            ready = work.select("*", *features).select(*kept, *inputs)
            work = model.transform(ready).select(*update)
        if h % every == 0 and h < horizon:
            work = cut_lineage(work)
    work = work.drop("_h")
    out = explode_forecast(work, [f"preds_{i}" for i in members], date_col=date_col)
    each = [F.col(f"y_pred_{i}") for i in members]
    return out.where(F.col(date_col).isNotNull()).withColumn(
        "y_pred", sum(each[1:], each[0]) / len(models)
    )
