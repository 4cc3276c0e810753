"""Point-in-time masks and their inverses (label re-attach, prediction write-back)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.sources.schemas import ENTITY


def _origin(origin) -> Column:
    return origin if isinstance(origin, Column) else F.lit(origin).cast("date")


def mask_target_after(df: DataFrame, origin, *, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """NULL the target strictly after the origin: a date, or a column such as ``train_end``."""
    known = F.col(date_col) <= _origin(origin)
    return df.withColumn(target_col, F.when(known, F.col(target_col)))


def mask_numeric_after(df: DataFrame, origin, *, date_col: str = "date", keys: Sequence[str] = ("store_nbr",)) -> DataFrame:
    """NULL every numeric non-key column after the origin; rows stay for lag alignment."""
    known = F.col(date_col) <= _origin(origin)
    return df.select(
        *[
            F.when(known, F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.NumericType) and f.name not in keys
            else F.col(f.name)
            for f in df.schema
        ]
    )


def mask_outcome_extras_after(extras: Mapping[str, DataFrame], origin, *, date_col: str = "date") -> dict[str, DataFrame]:
    """Mask the side tables that record outcomes; prices and calendars stay."""
    return {
        name: mask_numeric_after(df, origin, date_col=date_col) if name == "transactions" else df
        for name, df in extras.items()
    }


def mask_with_label(df: DataFrame, origin, *, date_col: str = "date", target_col: str = "sales", label_col: str = "y_true") -> DataFrame:
    """Keep the true target beside the masked one, so no join is needed to get it back."""
    return mask_target_after(df.withColumn(label_col, F.col(target_col)), origin,
                             date_col=date_col, target_col=target_col)


def write_back(
    panel: DataFrame, preds: DataFrame, *, keys: Sequence[str] = (*ENTITY, "date"),
    pred_col: str = "y_pred", target_col: str = "sales",
) -> DataFrame:
    """Predictions, where present, replace the target.

    A few weeks of forecasts are small on disk but not in memory, so they are never sent whole to
    every task through the driver: each task holds the predictions of its own entities.
    """
    right = preds.select(*keys, F.col(pred_col).alias("_pred")).hint("shuffle_hash")
    return panel.join(right, list(keys), "left").select(
        *[
            F.coalesce(F.col("_pred"), F.col(c)).alias(c) if c == target_col else F.col(c)
            for c in panel.columns
        ]
    )


def fill_from_oof(panel: DataFrame, oof: DataFrame, origin, **names) -> DataFrame:
    """Post-origin target := out-of-fold prediction, never the truth."""
    masked = mask_target_after(panel, origin, date_col=names.get("date_col", "date"),
                               target_col=names.get("target_col", "sales"))
    return write_back(masked, oof)
