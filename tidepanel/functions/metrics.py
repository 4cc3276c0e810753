"""Log-scale error metrics as aggregate Columns (sum/count only, so map-side combined).

A row whose error is not a finite number makes the score NULL: a forecast can't gain by missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _delta(y_true: Column | str, y_pred: Column | str, clipped: bool = False) -> Column:
    y = F.col(y_true) if isinstance(y_true, str) else y_true
    p = F.col(y_pred) if isinstance(y_pred, str) else y_pred
    if clipped:
        y, p = (F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))) for c in (y, p))
    return F.log1p(p) - F.log1p(y)


def _honest(agg: Column, delta: Column) -> Column:
    """Raise over zero rows; NULL if any row has no finite error, instead of leaving it out."""
    return F.when(
        F.count(F.lit(1)) > 0, F.when(n_invalid(delta) == 0, agg)
    ).otherwise(F.raise_error(F.lit("metric over zero rows")).cast("double"))


def n_invalid(delta: Column) -> Column:
    """Rows without a finite error: a side is missing, or at or below -1."""
    return F.count_if(delta.isNull() | F.isnan(delta) | (F.abs(delta) == float("inf")))


def invalid_rows(y_true: Column | str, y_pred: Column | str) -> Column:
    """Number of rows that make the scores NULL."""
    return n_invalid(_delta(y_true, y_pred))


def rmsle(y_true: Column | str, y_pred: Column | str) -> Column:
    """Root mean squared log1p error, without clipping; raises over zero rows."""
    d = _delta(y_true, y_pred)
    return _honest(F.sqrt(F.avg(d * d)), d)


def rmsle_clipped(y_true: Column | str, y_pred: Column | str) -> Column:
    """Same with both sides floored at zero."""
    d = _delta(y_true, y_pred, clipped=True)
    return _honest(F.sqrt(F.avg(d * d)), d)


def mae_log1p(y_true: Column | str, y_pred: Column | str) -> Column:
    d = _delta(y_true, y_pred)
    return _honest(F.avg(F.abs(d)), d)


def bias_log1p(y_true: Column | str, y_pred: Column | str) -> Column:
    """Signed log1p error; positive means over-prediction."""
    d = _delta(y_true, y_pred)
    return _honest(F.avg(d), d)


def score_columns(y_true: Column | str = "y_true", y_pred: Column | str = "y_pred") -> list[Column]:
    """Row count and the three scores, for any ``groupBy``."""
    return [
        F.count(F.lit(1)).alias("n"),
        rmsle(y_true, y_pred).alias("rmsle"),
        mae_log1p(y_true, y_pred).alias("mae_log1p"),
        bias_log1p(y_true, y_pred).alias("bias_log1p"),
    ]
