"""Queries over scans, sinks and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.catalog.registry import SCORES, oracle, query
from tidepanel.operators.clean import clean_structural
from tidepanel.operators.evaluation import fold_metrics, summarize_folds, with_slices
from tidepanel.operators.naive import naive_oof
from tidepanel.operators.splits import Fold, collect_folds, expand_folds, expanding_folds
from tidepanel.plans.prepare import prepare
from tidepanel.plans.train import OOF_COLUMNS, score_baseline
from tidepanel.session import saved, scratch_path
from tidepanel.sources.runs import (
    append_trials,
    load_folds,
    load_oof,
    remaining_trials,
    run_inventory,
    save_folds,
    save_oof,
    save_run,
    upsert,
    write_submission,
)
from tidepanel.sources.tables import (
    downcast_numeric,
    load_feature_extras,
    load_raw_tables,
    parse_dates,
    read_interim,
    write_interim,
    write_raw_tables,
)
from tidepanel.sources.warehouse import Warehouse

METHODS = ("last_value", "seasonal_naive_7", "seasonal_naive_14")


def folds_of(w: Warehouse) -> list[Fold]:
    """Three walk-forward folds from the dates of the training panel."""
    return collect_folds(expanding_folds(w.train_days()))


def oof_wide(w: Warehouse) -> DataFrame:
    """Naive forecasts of every fold; the filled panel has a value on each day, so two weeks hold the last one too."""
    folds = folds_of(w)
    return naive_oof(w.near(folds, 14), folds, periods=(7, 14))


def oof(w: Warehouse, folds: list[Fold] | None = None) -> DataFrame:
    folds = folds or folds_of(w)
    return score_baseline(w.near(folds, 7), folds, "seasonal_naive", 7)


def sliced_oof(w: Warehouse, with_stores: bool = True) -> DataFrame:
    folds = folds_of(w)
    return with_slices(oof(w, folds), folds, w.stores() if with_stores else None)


def raw_tables(w: Warehouse) -> dict[str, DataFrame]:
    return {
        "train": w.train(with_id=True), "test": w.test(), "stores": w.stores(), "oil": w.oil(),
        "holidays_events": w.holidays_events(), "transactions": w.transactions(),
        "sample_submission": w.sample_submission(),
    }


def written_raw(w: Warehouse) -> str:
    path = scratch_path(w.spark, "raw")
    write_raw_tables(raw_tables(w), path)
    return path


TABLE_COUNTS = """
SELECT 'train' AS table_name, COUNT(*) AS n_rows, SUM(sales) AS total FROM train UNION ALL
SELECT 'test', COUNT(*), CAST(SUM(onpromotion) AS DOUBLE) FROM test UNION ALL
SELECT 'stores', COUNT(*), CAST(SUM(cluster) AS DOUBLE) FROM stores UNION ALL
SELECT 'oil', COUNT(*), SUM({oil_col}) FROM {oil} UNION ALL
SELECT 'holidays_events', COUNT(*), CAST(SUM(CAST(transferred AS INT)) AS DOUBLE) FROM hol UNION ALL
SELECT 'transactions', COUNT(*), CAST(SUM(transactions) AS DOUBLE) FROM tx UNION ALL
SELECT 'sample_submission', COUNT(*), 0.0::DOUBLE FROM test"""
TOTALS = {
    "train": "sales", "test": "onpromotion", "stores": "cluster", "oil": "dcoilwtico",
    "holidays_events": "cast(transferred as int)", "transactions": "transactions", "sample_submission": "sales",
}
CLEAN_OIL = "SELECT date, last_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date) AS dcoilwtico FROM oil"


def table_totals(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.expr(TOTALS[name])).cast("double").alias("total"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("a1_load_raw_tables", oracle(TABLE_COUNTS.format(oil="oil", oil_col="dcoilwtico"), "total"))
def _(w):
    return table_totals(load_raw_tables(w.spark, written_raw(w)))


@query("a2_parse_dates", oracle("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders"))
def _(w):
    text = w.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return parse_dates(text)


@query("a5_interim_tables", oracle(TABLE_COUNTS.format(oil="filled", oil_col="dcoilwtico"), "total", filled=CLEAN_OIL))
def _(w):
    path = scratch_path(w.spark, "interim")
    write_interim(clean_structural(raw_tables(w)), path, {"train": ("store_nbr", "family", "date")}, placed=["train"])
    return table_totals(read_interim(w.spark, path, TOTALS))


@query("a6_feature_side_tables", oracle(
    "SELECT 'oil' AS table_name, COUNT(*) AS n_rows, SUM(dcoilwtico) AS total FROM oil UNION ALL "
    "SELECT 'stores', COUNT(*), CAST(SUM(cluster) AS DOUBLE) FROM stores", "total"))
def _(w):
    path = scratch_path(w.spark, "interim")
    write_interim({"oil": w.oil(), "stores": w.stores()}, path)
    return table_totals(load_feature_extras(w.spark, ["calendar", "oil", "store_meta"], path))


@query("a7_fold_manifest_sink", oracle("SELECT * FROM folds"))
def _(w):
    path = scratch_path(w.spark, "folds")
    save_folds(expanding_folds(w.train()), path)
    return load_folds(w.spark, path)


@query("a8_fold_manifest_join", oracle(
    "SELECT f.fold, COUNT(*) AS n_val, SUM(sales) AS total FROM train t JOIN folds f "
    "ON t.date BETWEEN f.val_start AND f.val_end GROUP BY 1", "total"))
def _(w):
    path = scratch_path(w.spark, "folds")
    save_folds(expanding_folds(w.train()), path)
    val = expand_folds(w.train(), collect_folds(load_folds(w.spark, path)), lookback_days=0).where("role = 'val'")
    return val.groupBy("fold").agg(F.count(F.lit(1)).alias("n_val"), F.sum("sales").alias("total"))


@query("a9_oof_sink", oracle("SELECT 'sn7' AS run_id, store_nbr, family, date, fold, y_true, y_pred FROM oof", "y_true y_pred"))
def _(w):
    path = scratch_path(w.spark, "oof")
    save_oof(oof(w), path, "sn7")
    return load_oof(w.spark, path, ["sn7"]).select("run_id", *OOF_COLUMNS)


def _stored_runs(w: Warehouse) -> str:
    path = scratch_path(w.spark, "runs")
    wide = saved(oof_wide(w), "oof")
    for m in METHODS:
        summary = summarize_folds(fold_metrics(wide, y_pred=m))
        save_run(summary, path, m, config={"method": m}, seed=42)
    return path


RUN_SCORES = f"SELECT method, fold, {SCORES} FROM oofl GROUP BY 1, 2"
RUN_MEANS = "SELECT method AS run_id, AVG(rmsle) AS mean_rmsle, STDDEV_SAMP(rmsle) AS std_rmsle, SUM(n)::BIGINT AS n_oof FROM runfolds GROUP BY 1"


@query("a10_run_metrics_sink", oracle(
    "SELECT run_id, mean_rmsle, std_rmsle, n_oof, CAST(42 AS INT) AS seed, '{\"method\": \"' || run_id || '\"}' AS config FROM runmeans",
    "mean_rmsle std_rmsle", runfolds=RUN_SCORES, runmeans=RUN_MEANS))
def _(w):
    runs = run_inventory(w.spark, _stored_runs(w))
    return runs.select("run_id", "mean_rmsle", "std_rmsle", "n_oof", "seed", "config")


@query("a11_run_inventory", oracle(
    "SELECT run_id, mean_rmsle, CAST(row_number() OVER (ORDER BY mean_rmsle, run_id) AS INT) AS place FROM runmeans",
    "mean_rmsle", runfolds=RUN_SCORES, runmeans=RUN_MEANS))
def _(w):
    runs = run_inventory(w.spark, _stored_runs(w))
    return runs.select("run_id", "mean_rmsle", F.row_number().over(Window.orderBy("mean_rmsle", "run_id")).alias("place"))


@query("a12_submission_sink", oracle("SELECT id, CAST(onpromotion AS DOUBLE) AS sales FROM test", "sales"))
def _(w):
    path = scratch_path(w.spark, "submission")
    preds = w.test().select("id", F.col("onpromotion").cast("double").alias("sales"))
    write_submission(preds, path, w.sample_submission())
    return w.spark.read.schema("id bigint, sales double").option("header", True).csv(path)


@query("a13_keyed_upsert", oracle(
    "SELECT store_nbr, SUM(sales) AS total, NULL::BIGINT AS n_days FROM train GROUP BY 1 HAVING SUM(sales) < 1000 UNION ALL "
    "SELECT store_nbr, SUM(sales), COUNT(DISTINCT date) FROM train GROUP BY 1 HAVING SUM(sales) >= 1000", "total"))
def _(w):
    # One row per store, read three times below: stored, so that the panel is filled once.
    report = saved(w.train().groupBy("store_nbr").agg(F.sum("sales").alias("total"), F.count_distinct("date").alias("n_days")), "report")
    fresh = report.where("total >= 1000")
    return upsert(report.drop("n_days"), fresh, ["store_nbr"])


@query("a16_trial_resume", oracle(
    "SELECT store_nbr AS trial, COUNT(*) AS n_rows FROM train GROUP BY 1 HAVING SUM(onpromotion) < 0.13 * COUNT(*)"))
def _(w):
    path = scratch_path(w.spark, "trials")
    planned = w.train().groupBy(F.col("store_nbr").alias("trial")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("onpromotion").alias("p"))
    state = F.when(F.col("p") >= 0.13 * F.col("n_rows"), "COMPLETE").otherwise("RUNNING")
    append_trials(planned.select("trial", state.alias("state")), path)
    return remaining_trials(planned.drop("p"), w.spark.read.parquet(path))


@query("a18_downcast", oracle(
    "SELECT date, store_nbr, family, CAST(sales AS FLOAT) AS sales, onpromotion, CAST(id AS INT) AS id FROM train_id"))
def _(w):
    return downcast_numeric(w.train(with_id=True)).select("date", "store_nbr", "family", "sales", "onpromotion", "id")


@query("o1_structural_clean", oracle(
    "SELECT t.date, store_nbr, family, sales, onpromotion, dcoilwtico FROM train t LEFT JOIN filled f ON t.date = f.date",
    "sales dcoilwtico", filled=CLEAN_OIL))
def _(w):
    clean = clean_structural({"train": w.train(), "oil": w.oil(), "holidays_events": w.holidays_events()})
    return clean["train"].join(F.broadcast(clean["oil"]), "date", "left")


@query("o1_densify", oracle("SELECT * FROM panel", "sales"))
def _(w):
    return w.panel()


@query("o4_prepare_job", oracle(
    "SELECT 'train' AS table_name, COUNT(*) AS n_rows FROM train UNION ALL SELECT 'test', COUNT(*) FROM test UNION ALL "
    "SELECT 'stores', COUNT(*) FROM stores UNION ALL SELECT 'oil', COUNT(*) FROM oil UNION ALL "
    "SELECT 'holidays_events', COUNT(*) FROM hol UNION ALL SELECT 'transactions', COUNT(*) FROM tx UNION ALL "
    "SELECT 'sample_submission', COUNT(*) FROM test UNION ALL SELECT 'folds', 3"))
def _(w):
    interim, splits = scratch_path(w.spark, "interim"), scratch_path(w.spark, "splits")
    counts = prepare(w.spark, written_raw(w), interim, splits)["counts"]
    n_folds = load_folds(w.spark, splits).agg(F.lit("folds").alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
    return counts.unionByName(n_folds)
