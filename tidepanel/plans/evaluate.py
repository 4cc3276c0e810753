"""Locked evaluation of stored forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidepanel.operators.evaluation import (
    NAIVE_FLOOR,
    fold_metrics,
    gate_vs_naive,
    horizon_metrics,
    segment_table,
    summarize_folds,
    with_slices,
)
from tidepanel.operators.splits import Fold
from tidepanel.session import saved
from tidepanel.sources.runs import write_report

# Segment columns of the evaluation report.
SEGMENTS = ("family", "cluster", "is_zero", "is_payday")


def evaluate(
    oof: DataFrame, folds: Sequence[Fold], stores: DataFrame | None = None, *, out_dir: str | None = None,
    segments: Sequence[str] = SEGMENTS, min_n: int = 1, floor: float = NAIVE_FLOOR,
) -> dict[str, DataFrame]:
    """Metrics with gate, by fold, by horizon and by segment, from one annotated table."""
    sliced = saved(with_slices(oof, folds, stores), "oof")
    per_fold = fold_metrics(sliced)
    have = [c for c in segments if c in sliced.columns]
    tables = {
        "metrics": gate_vs_naive(summarize_folds(per_fold), floor=floor),
        "folds": per_fold,
        "horizon": horizon_metrics(sliced),
        "segments": segment_table(sliced, have, min_n=min_n),
    }
    if out_dir:
        write_report(tables, out_dir)
    return tables


def passes(metrics: DataFrame) -> bool:
    return metrics.first()["go_no_go"] == "GO"
