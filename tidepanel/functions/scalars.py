"""Column helpers for dates, clipping, coercion and target transforms."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- dates -------------------------------------------------------------------
def weekday0(date: Column | str) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_c(date))


def is_month_end(date: Column | str) -> Column:
    return _c(date) == F.last_day(_c(date))


def is_payday(date: Column | str) -> Column:
    """15th or last day of the month, as 0/1."""
    return ((F.dayofmonth(_c(date)) == 15) | is_month_end(date)).cast("int")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_c(later), _c(earlier))


def parse_date(col: Column | str, fmt: str | None = None, strict: bool = True) -> Column:
    """Strict parsing raises on bad text; otherwise bad text becomes NULL."""
    col = _c(col)
    if strict:
        return F.to_date(col, fmt) if fmt else col.cast("date")
    return F.try_to_date(col, fmt or "yyyy-MM-dd")


# --- numbers -----------------------------------------------------------------
def clip(col: Column | str, lower=None, upper=None) -> Column:
    """Clip to bounds; NULL stays NULL (greatest/least alone would skip it)."""
    col = _c(col)
    out = col
    if lower is not None:
        out = F.greatest(out, lower if isinstance(lower, Column) else F.lit(lower))
    if upper is not None:
        out = F.least(out, upper if isinstance(upper, Column) else F.lit(upper))
    return F.when(col.isNotNull(), out)


def nan_to_null(col: Column | str) -> Column:
    col = _c(col).cast("double")
    return F.when(~F.isnan(col), col)


def to_number(col: Column | str) -> Column:
    """Coerce to double; text that is no number, and NaN, become NULL."""
    return nan_to_null(_c(col).try_cast("double"))


def is_finite(col: Column | str) -> Column:
    col = _c(col).cast("double")
    return F.coalesce(~F.isnan(col) & (F.abs(col) < F.lit(math.inf)), F.lit(False))


def nonnegative(col: Column | str, enabled: bool = True) -> Column:
    """Prediction clip policy."""
    return clip(_c(col).cast("double"), lower=0.0) if enabled else _c(col).cast("double")


# --- target transform --------------------------------------------------------
@dataclass(frozen=True)
class Transform:
    """A scale for the target: the way to it and back."""

    forward: Callable[[Column], Column]
    back: Callable[[Column], Column]


TRANSFORMS = {
    "log1p": Transform(lambda y: F.log1p(clip(y, lower=0.0)), F.expm1),
    "identity": Transform(lambda y: y, lambda y: y),
}


def _transform(kind: str | None) -> Transform:
    """``none`` and None stand for the identity."""
    kind = "identity" if kind in (None, "none") else kind
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown target transform {kind!r}; known: {sorted(TRANSFORMS)}")
    return TRANSFORMS[kind]


def transform_target(col: Column | str, kind: str | None = "log1p") -> Column:
    return _transform(kind).forward(_c(col).cast("double"))


def inverse_target(col: Column | str, kind: str | None = "log1p") -> Column:
    return _transform(kind).back(_c(col).cast("double"))

# --- key-hash randomness -----------------------------------------------------
def hash_uniform(*parts: Column) -> Column:
    """Uniform in (0,1) from a text key: same value for any partitioning or row order."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def hash_normal(*parts: Column) -> Column:
    """Standard normal from a text key (two hash uniforms, Box-Muller)."""
    u1 = hash_uniform(*parts, F.lit("u1"))
    u2 = hash_uniform(*parts, F.lit("u2"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
