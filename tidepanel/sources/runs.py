"""Sinks and sources of folds, forecasts, run metrics, trials and submissions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.contracts import validate_submission
from tidepanel.operators.splits import Fold, collect_folds, folds_frame
from tidepanel.sources.schemas import FOLD_SCHEMA, OOF_REQUIRED, require_columns


def save_folds(folds: DataFrame, path: str) -> None:
    """Fold bounds only: membership is the date range, so no row ids are stored."""
    folds.select(*FOLD_SCHEMA.fieldNames()).coalesce(1).write.mode("overwrite").json(path)


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOLD_SCHEMA).json(path)


def load_fold_list(spark: SparkSession, path: str) -> list[Fold]:
    return collect_folds(load_folds(spark, path))


def save_oof(oof: DataFrame, root: str, run_id: str) -> None:
    """Replaces the run's own partitions only; other runs stay."""
    require_columns(oof, OOF_REQUIRED, "forecast table")
    tagged = oof.withColumn("run_id", F.lit(run_id))
    (
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "fold").parquet(root)
    )


def load_oof(spark: SparkSession, root: str, run_ids: Sequence[str] | None = None) -> DataFrame:
    """Partition columns prune whole runs and folds."""
    df = require_columns(spark.read.parquet(root), OOF_REQUIRED, "forecast table")
    return df.where(F.col("run_id").isin(*run_ids)) if run_ids is not None else df


def save_run(metrics: DataFrame, root: str, run_id: str, config: Mapping | None = None,
             seed: int | None = None, extra: Mapping | None = None) -> None:
    """One-row metrics keyed by run id, with the configuration as JSON text."""
    row = metrics.withColumns({
        "run_id": F.lit(run_id),
        "seed": F.lit(seed).cast("int"),
        "config": F.lit(json.dumps(config or {}, sort_keys=True, default=str)),
        "extra": F.lit(json.dumps(extra or {}, sort_keys=True, default=str)),
    })
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(root)


METRIC_SCHEMA = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("mean_rmsle", "std_rmsle", "mean_mae_log1p", "pooled_oof_rmsle")]
    + [T.StructField("n_oof", T.LongType()), T.StructField("seed", T.IntegerType()),
       T.StructField("config", T.StringType()), T.StructField("run_id", T.StringType())]
)


def run_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every stored run, best score first."""
    return spark.read.schema(METRIC_SCHEMA).json(root).orderBy("mean_rmsle", "run_id")


def finished_runs(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(METRIC_SCHEMA).json(root)
    except AnalysisException:
        return None


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows with the same key; columns may differ."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def remaining_trials(planned: DataFrame, done: DataFrame, key: str = "trial") -> DataFrame:
    """Planned trials without a completed record: a resumed search runs only these."""
    complete = done.where(F.col("state") == "COMPLETE").select(key).distinct()
    return planned.join(complete, key, "left_anti")


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").parquet(path)


def write_submission(sub: DataFrame, path: str, sample: DataFrame | None = None, order_by: str = "id") -> None:
    """CSV sorted by id across part files; range-partitioned, so no single writer task.

    The rows are checked first, against the sample where given.
    """
    require_columns(sub, ["id", "sales"], "submission")
    out = sub.select("id", "sales")
    validate_submission(out, sample if sample is not None else out)
    (
        out.repartitionByRange(order_by).sortWithinPartitions(order_by)
        .write.mode("overwrite").option("header", True).csv(path)
    )


def write_report(tables: Mapping[str, DataFrame], out_dir: str) -> None:
    """Named report tables (metrics, horizon, segment, scenario) as JSON folders."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{out_dir.rstrip('/')}/{name}")


__all__ = [
    "append_trials", "finished_runs", "folds_frame", "load_fold_list", "load_folds", "load_oof",
    "remaining_trials", "run_inventory", "save_folds", "save_oof", "save_run", "upsert",
    "write_report", "write_submission",
]
