"""Panel unions and per-fold matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.features import (
    RECURSIVE_GROUPS,
    build_feature_matrix,
    feature_columns,
)
from tidepanel.operators.masks import mask_outcome_extras_after, mask_with_label
from tidepanel.operators.splits import Fold, near_origin
from tidepanel.sources.schemas import ENTITY, require_columns


def prune_panel(df: DataFrame, *, entity_cols: Sequence[str] = ENTITY, date_col: str = "date",
                target_col: str = "sales", known: Sequence[str] = ("onpromotion",)) -> DataFrame:
    """Key, target and known columns only; the selection reaches the scan."""
    want = ["id", *entity_cols, date_col, target_col, *known]
    return df.select(*[c for c in want if c in df.columns])


def train_test_panel(train: DataFrame, test: DataFrame, *, entity_cols: Sequence[str] = ENTITY,
                     date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """Train rows and test rows, the test target forced to NULL."""
    require_columns(train, [*entity_cols, date_col, target_col], "train")
    require_columns(test, [*entity_cols, date_col], "test")
    hidden = test.withColumn(target_col, F.lit(None).cast(train.schema[target_col].dataType))
    shared = [c for c in train.columns if c in hidden.columns]
    return train.select(*shared).unionByName(hidden.select(*shared))


def fold_matrix(
    panel: DataFrame, fold: Fold, *, groups: Sequence[str], extras: Mapping[str, DataFrame] | None = None,
    **build,
) -> DataFrame:
    """Leak-free matrix of one fold: masked target and outcomes, features, label kept aside.

    Rows past the fold never enter; ``role`` tells training from validation.
    """
    inside = panel.where(F.col("date") <= F.lit(fold.val_end))
    masked = mask_with_label(inside, fold.train_end)
    safe = mask_outcome_extras_after(extras or {}, fold.train_end)
    out = build_feature_matrix(masked, groups=groups, extras=safe, **build)
    role = F.when(F.col("date") <= F.lit(fold.train_end), "train").when(
        F.col("date") >= F.lit(fold.val_start), "val").otherwise("gap")
    keep = list(dict.fromkeys([*ENTITY, "date", *feature_columns(groups), "y_true"]))
    return out.select(*keep, role.alias("role"), F.lit(fold.fold).alias("fold"))


def fold_matrices(
    panel: DataFrame, folds: Sequence[Fold], *, groups: Sequence[str], extras: Mapping[str, DataFrame] | None = None,
    history: int = 56, **build,
) -> DataFrame:
    """The rows of ``fold_matrix`` of every fold, with one pass of the features over the history.

    Up to an origin its mask changes nothing, as every feature looks strictly back: those rows are made
    once and handed to each fold they belong to. Only rows past an origin are made per fold, from the
    last ``history`` rows of each entity (no feature looks back further).
    """
    names = list(dict.fromkeys([*ENTITY, "date", *feature_columns(groups), "y_true"]))
    last = max(f.train_end for f in folds)
    past = build_feature_matrix(panel.where(F.col("date") <= F.lit(last)), groups=groups, extras=extras, **build)
    inside = [F.when(F.col("date") <= F.lit(f.train_end), F.lit(f.fold)) for f in folds]
    train = past.withColumn("y_true", F.col("sales")).select(
        *names, F.lit("train").alias("role"), F.explode(F.array_compact(F.array(*inside))).alias("fold"))
    ahead = [
        fold_matrix(near_origin(panel, f, history), f, groups=groups, extras=extras, **build).where(F.col("date") > F.lit(f.train_end))
        for f in folds
    ]
    return reduce(DataFrame.unionByName, ahead, train)


def training_matrix(panel: DataFrame, *, groups: Sequence[str], extras: Mapping[str, DataFrame] | None = None, **build) -> DataFrame:
    """Features of all training rows of all folds at once.

    Every feature looks strictly back, so for rows up to an origin the origin mask changes
    nothing: one matrix serves every fold, cut by date.
    """
    out = build_feature_matrix(panel, groups=groups, extras=extras, **build)
    keep = list(dict.fromkeys([*ENTITY, "date", *feature_columns(groups)]))
    return out.select(*keep, F.col("sales").alias("y_true"))


def horizon_matrix(
    panel: DataFrame, fold: Fold, *, groups: Sequence[str], extras: Mapping[str, DataFrame] | None = None,
    history: int = 56, **build,
) -> DataFrame:
    """Rows around one origin with all features that do not depend on the target.

    ``history`` counts rows of an entity, as lags do, not days.
    """
    near = near_origin(panel, fold, history)
    safe = mask_outcome_extras_after(extras or {}, fold.train_end)
    known = [g for g in groups if g not in RECURSIVE_GROUPS]
    return build_feature_matrix(near, groups=known, extras=safe, **build)
