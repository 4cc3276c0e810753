"""Recursion, fitted models, jobs and sinks."""

import math

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from tests.conftest import column, day, panel
from tidepanel.catalog import models
from tidepanel.catalog.registry import ORACLES, QUERIES
from tidepanel.operators import recursive as R
from tidepanel.operators import boosting, growth, trees
from tidepanel.operators import target_stats as stats
from tidepanel.operators.evaluation import fold_metrics, group_importance, summarize_folds
from tidepanel.operators.features import add_lag_features, add_rolling_features, build_feature_matrix, feature_columns, model_columns
from tidepanel.operators.panel import training_matrix
from tidepanel.operators.splits import Fold
from tidepanel.plans import evaluate, predict, prepare, train, tune
from tidepanel.plans.stress import run_stress
from tidepanel.sources import runs, tables
from tidepanel.sources.warehouse import Warehouse

FOLD = Fold(0, day(9), day(10), day(12))
KEYS = ["store_nbr", "family", "date"]


def test_recursion_feeds_predictions_back(spark):
    df = panel(spark, [1000 + i for i in range(16)])
    state = R.origin_state(df, [FOLD])
    seen = R.forecast_column(state, lambda x: x["sales_lag_1"] + 1, ["sales_lag_1"])
    assert column(seen, "y_pred") == [1010, 1011, 1012] and column(seen, "y_true") == [1010, 1011, 1012]
    flat = R.forecast_column(state, lambda x: F.lit(42.0), [])
    assert column(flat, "y_pred") == [42, 42, 42]
    clipped = R.forecast_column(state, lambda x: F.lit(-5.0), [])
    assert column(clipped, "y_pred") == [0, 0, 0]


def test_recursion_matches_pandas(spark):
    rng = np.random.default_rng(2)
    y = rng.gamma(2, 3, 40)
    y[35] = np.nan
    df = panel(spark, [None if np.isnan(v) else v for v in y])
    fold = Fold(0, day(36), day(37), day(39))
    cols = ["sales_lag_1", "sales_lag_7", "sales_roll_mean_7", "sales_roll_std_14"]
    w = {"sales_lag_1": 0.3, "sales_lag_7": 0.2, "sales_roll_mean_7": 0.4, "sales_roll_std_14": 0.1}
    got = column(R.forecast_column(R.origin_state(df, [fold]), R.linear_model(w, 0.5), cols), "y_pred")
    series, want = list(y[:37]), []
    for _ in range(3):
        s = pd.Series(series)
        x = {"sales_lag_1": s.iloc[-1], "sales_lag_7": s.iloc[-7], "sales_roll_mean_7": s[-7:].mean(), "sales_roll_std_14": s[-14:].std()}
        p = 0.5 + sum(w[c] * (0 if np.isnan(x[c]) else x[c]) for c in cols)
        want.append(p)
        series.append(p)
    assert got == pytest.approx(want, rel=1e-12)


def seasonal(spark, n=120, stores=3):
    rows = []
    for s in range(stores):
        for i in range(n):
            base = 20 + 15 * s + 12 * math.sin(2 * math.pi * (i % 7) / 7) + 10 * (i % 3 == 0)
            noise = ((i * 7919 + s * 104729) % 17 - 8) / 2
            rows.append((s, "A" if s % 2 else "B", day(i), max(base + noise, 0.0), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "store_nbr int, family string, date date, sales double, onpromotion int").persist()


@pytest.fixture(scope="module")
def season(spark):
    return seasonal(spark)


SEASON_FOLDS = [Fold(0, day(105), day(106), day(110)), Fold(1, day(110), day(111), day(115))]
GROUPS = ("base", "calendar", "promo", "lag", "rolling")


def test_column_and_transformer_recursion_agree(spark, season):
    cols = ["sales_lag_1", "sales_lag_7", "sales_roll_mean_7", "onpromotion"]
    fold = SEASON_FOLDS[0]
    matrix = build_feature_matrix(season, groups=["base", "lag", "rolling"]).where(F.col("date") <= F.lit(fold.train_end))
    model, _ = trees.fit_model(matrix.withColumn("y_true", F.col("sales")), cols, family="linear", target_transform="identity")
    fitted = model.stages[-1]
    names = trees.vector_names(model)
    state = R.origin_state(season, [fold], ["onpromotion"])
    by_model = R.forecast_transformer(state, [model], cols, 5, target_transform="identity", checkpoint_every=2)
    coef = dict(zip(names[:4], fitted.coefficients[:4]))
    by_column = R.forecast_column(state, R.linear_model(coef, fitted.intercept), cols)
    a = {tuple(r[k] for k in KEYS): r["y_pred"] for r in by_model.collect()}
    b = {tuple(r[k] for k in KEYS): r["y_pred"] for r in by_column.collect()}
    assert a.keys() == b.keys() and len(a) == 15
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def test_trees_beat_seasonal_naive_and_reproduce(spark, season, tmp_path):
    fit = {"params": {"n_estimators": 12, "max_depth": 4, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0}, "seed": 7}
    oof, models, _ = train.score_trees(season, SEASON_FOLDS, groups=GROUPS, fit=fit, models_dir=str(tmp_path / "models"))
    score = summarize_folds(fold_metrics(oof)).first()
    naive = summarize_folds(fold_metrics(train.score_baseline(season, SEASON_FOLDS, "seasonal_naive", 7))).first()
    assert score["n_oof"] == 30 and score["mean_rmsle"] < naive["mean_rmsle"]
    again, _, _ = train.score_trees(season, SEASON_FOLDS, groups=GROUPS, fit=fit)
    assert sorted(map(tuple, oof.collect())) == sorted(map(tuple, again.collect()))
    loaded = trees.load_fold_models(str(tmp_path / "models"), 2)
    first = train.forecast_fold(season, SEASON_FOLDS[0], loaded[:1], groups=GROUPS)
    assert sorted(r["y_pred"] for r in first.collect()) == pytest.approx(sorted(r["y_pred"] for r in oof.where("fold = 0").collect()))
    gains = trees.importances(spark, models[0], 0)
    groups = {r["feature_group"]: r["mean_gain"] for r in group_importance(gains, {g: model_columns([g]) for g in GROUPS}).collect()}
    assert sum(groups.values()) == pytest.approx(1.0)
    tables = run_stress(season, oof, SEASON_FOLDS, models, groups=GROUPS)
    rows = {r["scenario"]: r for r in tables["scenarios"].collect()}
    assert rows["missing_oil_holiday_join"]["status"] == "not_applicable" and rows["lag_history_spike_clip"]["status"] == "ok"
    assert rows["noise_rel_10pct"]["delta_rmsle"] is not None
    pay = rows["payday_subset_vs_complement"]
    assert pay["status"] == "ok" and pay["stressed_rmsle"] == pytest.approx(tables["payday"].first()["pooled_payday_rmsle"])
    assert pay["delta_rmsle"] == pytest.approx(pay["stressed_rmsle"] - score["mean_rmsle"])
    # With the forecasts filled in, the frozen models reproduce the clean scores.
    assert rows["lag_history_spike_clip"]["clean_fold_mean_rmsle"] == pytest.approx(score["mean_rmsle"], rel=1e-9)


@pytest.mark.parametrize("params", [{}, {"regParam": 0.1}, {"regParam": 0.05, "elasticNetParam": 0.5}])
def test_linear_fits_of_all_folds_come_from_one_pass(spark, season, monkeypatch, params):
    cols, ends = model_columns(GROUPS), [f.train_end for f in SEASON_FOLDS]
    matrix = train.model_matrix(season, groups=GROUPS)
    encoder, vectors = train.encode_matrix(matrix, cols, "linear")
    whole = [train.fit_encoded_fold(vectors, encoder, e, family="linear", params=params)[0] for e in ends]
    for a, (b, info) in zip(whole, train.fit_linear_folds(matrix, cols, ends, params)):
        mine, theirs = (trees.predict(train.fitted_rows(matrix, cols), m, cols).orderBy(*KEYS).collect() for m in (b, a))
        assert [r["y_pred"] for r in mine] == pytest.approx([r["y_pred"] for r in theirs], rel=5e-3) and info["stopped_on"] is None
    monkeypatch.setattr(train, "fit_encoded_fold", None)  # no fold is fitted on the rows themselves
    oof, models, notes = train.score_trees(season, SEASON_FOLDS, groups=GROUPS, matrix=matrix, fit={"family": "linear", "params": params})
    assert oof.count() == 30 and len(models) == len(notes) == 2
    with pytest.raises(ValueError):
        train.fit_linear_folds(matrix, cols, [day(-5)], params)


def test_params_and_patience():
    p = trees.spark_params({"eta": 0.1, "num_leaves": 64, "n_estimators": 10, "reg_lambda": 3.0})
    assert p["stepSize"] == 0.1 and p["maxDepth"] == 6 and p["maxIter"] == 10 and "reg_lambda" not in p
    assert trees.spark_params({"n_estimators": 9}, "forest")["numTrees"] == 9
    with pytest.raises(ValueError):
        trees.spark_params({}, "mystery")
    assert trees.best_round([5, 4, 3, 3.5, 3.6, 1], patience=2) == 3
    assert trees.best_round([5, 4, 3, 3.5, 1, 2], patience=3) == 5


def test_early_stopping_uses_holdout(season):
    matrix = training_matrix(season, groups=["base", "calendar"])
    cut = F.col("date") < F.lit(day(90))
    _, info = trees.fit_model(matrix.where(cut), feature_columns(["base", "calendar"]), holdout=matrix.where(~cut),
                              params={"n_estimators": 4, "max_depth": 2}, patience=2)
    assert 1 <= info["best_iteration"] <= info["fitted_rounds"] <= 4


def test_search_in_rungs_resumes_with_the_same_winner(spark, season, tmp_path):
    space = {"learning_rate": {"type": "log_float", "low": 0.05, "high": 0.5}, "max_depth": {"type": "int", "low": 1, "high": 3}}
    kw = dict(space=space, groups=["base", "calendar"], val_days=5, rungs=[1, 3], share=0.5)
    path = str(tmp_path / "trials")
    full = tune.run_search(season, SEASON_FOLDS, path, n_trials=4, **kw)
    rows = [r.asDict() for r in full.orderBy("rung", "trial").collect()]
    assert [(r["rung"], r["mean_rounds"]) for r in rows] == [(0, 1.0)] * 4 + [(1, 3.0)] * 2
    first = sorted(rows[:4], key=lambda r: (r["value"], r["trial"]))
    assert {r["trial"] for r in rows[4:]} == {r["trial"] for r in first[:2]}
    winner = tune.retrain_spec(full, "x", list(space))["params"]
    best = min(rows[4:], key=lambda r: (r["value"], r["trial"]))
    assert winner == {k: best[k] for k in space}
    # Cut off after two trials of the first rung: the rest runs, nothing runs twice.
    part = str(tmp_path / "part")
    runs.append_trials(full.where("rung = 0 and trial < 2"), part)
    again = tune.run_search(season, SEASON_FOLDS, part, n_trials=4, **kw)
    assert again.count() == 6 and tune.retrain_spec(again, "x", list(space))["params"] == winner
    values = lambda t: [(r["rung"], r["trial"], round(r["value"], 9)) for r in t.orderBy("rung", "trial").collect()]
    assert values(again) == values(full)


def test_joint_search_takes_columns_by_group(spark, season, tmp_path):
    extras = {
        "oil": season.select("date").distinct().withColumn("dcoilwtico", F.dayofmonth("date").cast("double")),
        "holidays_events": spark.createDataFrame(
            [(day(7), "Holiday", "National", "c", "d", False)], "date date, type string, locale string, locale_name string, description string, transferred boolean"),
        "stores": spark.createDataFrame([(i, "c", f"s{i}", "A", i) for i in range(3)], "store_nbr int, city string, state string, type string, cluster int"),
        "transactions": season.select("date", "store_nbr").distinct().withColumn("transactions", F.dayofmonth("date")),
    }
    space = {"learning_rate": {"type": "float", "low": 0.1, "high": 0.3}}
    trials = tune.run_search(season, SEASON_FOLDS[:1], str(tmp_path / "t"), n_trials=3, space=space, joint_groups=True, extras=extras,
                             val_days=5, rungs=[2], fixed={"max_depth": 2}).collect()
    assert len(trials) == 3 and len({(r["oil"], r["holiday"], r["store_meta"], r["transactions"]) for r in trials}) > 1
    assert all(r["value"] > 0 for r in trials)
    with pytest.raises(ValueError, match="recursively"):
        tune.run_search(season, SEASON_FOLDS[:1], "unused", n_trials=1, space=space, joint_groups=True, recursive=True)


def test_runs_are_reused(spark, season, tmp_path):
    out = str(tmp_path / "outputs")
    inventory = train.run_matrix(season, SEASON_FOLDS, out, train.NAIVE_RUNS)
    assert inventory.count() == 3
    scores = column(inventory, "mean_rmsle", "mean_rmsle")
    assert scores == sorted(scores)
    assert train.run_matrix(season, SEASON_FOLDS, out, train.NAIVE_RUNS[:1]).count() == 1
    assert runs.load_oof(spark, f"{out}/oof", ["000_last_value"]).count() == 30


def test_predict_and_submit(spark, season, tmp_path):
    rows = season.withColumn("id", F.col("store_nbr") * 1000 + F.datediff("date", F.lit(day(0)))).withColumn("id", F.col("id").cast("bigint"))
    past, future = rows.where(F.col("date") <= F.lit(day(112))), rows.where(F.col("date") > F.lit(day(112))).drop("sales")
    tx = past.select("date", "store_nbr").withColumn("transactions", F.dayofmonth("date"))
    groups, extras = ("base", "lag", "transactions"), {"transactions": tx}
    model = predict.retrain_full(past, groups=groups, extras=extras, fit={"family": "linear"})
    preds = predict.predict_test(past, future, [model, model], groups=groups, extras=extras)
    sample = future.select("id", F.lit(0.0).alias("sales"))
    path = str(tmp_path / "submission")
    aligned = predict.submit(preds, sample, path)
    assert aligned.count() == 21 and aligned.where("sales is null or sales < 0").count() == 0
    back = spark.read.option("header", True).schema("id bigint, sales double").csv(path)
    assert back.count() == 21


def test_prepare_job_from_csv(spark, season, tmp_path):
    rows = season.withColumn("id", F.monotonically_increasing_id())
    made = {
        "train": rows, "test": rows.limit(3), "sample_submission": rows.limit(3),
        "stores": spark.createDataFrame([(0, "c", "s", "A", 1)], "store_nbr int, city string, state string, type string, cluster int"),
        "oil": spark.createDataFrame([(day(0), 1.0), (day(1), None)], "date date, dcoilwtico double"),
        "holidays_events": spark.createDataFrame([(day(0), "Holiday", "Local", "c", "d", False)],
                                                 "date date, type string, locale string, locale_name string, description string, transferred boolean"),
        "transactions": spark.createDataFrame([(day(0), 0, 5)], "date date, store_nbr int, transactions int"),
    }
    # Of quotes of one day the last in the file counts, not the greatest.
    made["oil"] = spark.createDataFrame([(day(0), 50.0), (day(0), 49.0), (day(1), None)], "date date, dcoilwtico double").coalesce(1)
    raw = str(tmp_path / "raw")
    with pytest.raises(FileNotFoundError, match="train"):
        tables.load_raw_tables(spark, raw)
    tables.write_raw_tables(made, raw)
    out = prepare.prepare(spark, raw, str(tmp_path / "interim"), str(tmp_path / "splits"), {"min_train_days": 30, "n_folds": 2})
    assert {r["table_name"]: r["n_rows"] for r in out["counts"].collect()}["train"] == 360
    folds = runs.load_fold_list(spark, str(tmp_path / "splits"))
    assert [f.fold for f in folds] == [0, 1] and folds[1].val_end == day(119)
    only = tables.load_feature_extras(spark, ["calendar", "oil"], str(tmp_path / "interim"))
    assert list(only) == ["oil"] and column(only["oil"], "dcoilwtico") == [49.0, 49.0]


def test_evaluate_job(spark, season, tmp_path):
    oof = train.score_baseline(season, SEASON_FOLDS, "last_value")
    out = evaluate.evaluate(oof, SEASON_FOLDS, out_dir=str(tmp_path / "eval"), min_n=1)
    assert out["horizon"].count() == 5 and out["folds"].count() == 3
    assert evaluate.passes(out["metrics"]) == (out["metrics"].first()["mean_rmsle"] < 0.5513)
    assert spark.read.json(str(tmp_path / "eval/segments")).count() == out["segments"].count()


def test_upsert_and_resume(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int")
    new = spark.createDataFrame([("b", 9, "x")], "run_id string, v int, note string")
    assert {(r["run_id"], r["v"], r["note"]) for r in runs.upsert(old, new, ["run_id"]).collect()} == {("a", 1, None), ("b", 9, "x")}
    done = spark.createDataFrame([(0, "COMPLETE"), (1, "FAIL")], "trial int, state string")
    assert column(runs.remaining_trials(spark.range(3).withColumnRenamed("id", "trial"), done), "trial", "trial") == [1, 2]


def test_bucketed_panel_needs_no_shuffle(spark, season, tmp_path):
    keys = ["store_nbr", "family"]
    stored = tables.write_bucketed(season, "season_bucketed", str(tmp_path / "bucketed"), keys=keys, sort=["date"], buckets=4)
    made = build_feature_matrix(stored, groups=["lag", "rolling"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    plain = build_feature_matrix(season, groups=["lag", "rolling"])
    assert sorted(map(str, made.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    spark.sql("DROP TABLE season_bucketed")


def test_lag_features_after_gap_filling_reuse_its_shuffle(spark):
    from tidepanel.operators.clean import densify

    sparse = panel(spark, [1, 0, 3, 0, 5]).where("sales > 0")
    dense = densify(sparse, entity_cols=["store_nbr", "family"], date_col="date", start="2017-01-01", end="2017-01-05",
                    fill={"sales": 0.0, "onpromotion": 0}, partitions=3)
    made = build_feature_matrix(dense, groups=["lag", "rolling"])
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert column(made, "sales_lag_1") == [None, 1, 0, 3, 0]


def test_recursion_agrees_with_the_matrix_on_gappy_rows_and_long_windows(spark):
    rows = [(1, "A", day(5 * i), float(i * 13 % 11), 0) for i in range(80)]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, sales double, onpromotion int")
    fold = Fold(0, day(390), day(391), day(395))
    made = add_rolling_features(add_lag_features(df, lags=[1, 14, 56]), windows=[7, 56])
    want = made.where(F.col("date") == F.lit(day(395))).first()
    names = ["sales_lag_1", "sales_lag_14", "sales_lag_56", "sales_roll_mean_56", "sales_roll_std_7"]
    state = R.origin_state(df, [fold], history=R.history_for(names))
    assert R.history_for(names) == 56
    got = state.select(*[c.alias(n) for n, c in R.recursive_features(F.col("hist"), names).items()]).first()
    assert [got[n] for n in names] == pytest.approx([want[n] for n in names])


def test_text_columns_with_many_levels_fit(spark):
    rows = [(f"level {i % 150}", float(i % 150), day(i % 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "kind string, y_true double, date date")
    model, info = trees.fit_model(df, ["kind"], params={"maxIter": 2, "maxDepth": 2})
    assert info["params"]["maxBins"] >= 151 and model.stages[-1].getNumTrees == 2


def boosted_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(scale=0.3, size=n)
    rows = [(float(b), Vectors.dense(a.tolist())) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ["label", "features"]).persist()


BOOST = {"maxIter": 40, "stepSize": 0.3, "maxDepth": 3, "maxBins": 32, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def test_boosting_is_fit_and_cut_without_fitting_twice(spark):
    fit, held = boosted_rows(spark, 600, 1), boosted_rows(spark, 200, 2)
    model, info = boosting.boost(fit, held, BOOST, seed=5, patience=4, first_block=3)
    whole = GBTRegressor(seed=5, **BOOST).fit(fit)
    errors = whole.evaluateEachIteration(held, "squared")
    assert info["errors"] == pytest.approx(errors[:len(info["errors"])], rel=1e-9)
    assert info["best_iteration"] == boosting.best_round(errors, 4) == model.getNumTrees
    assert info["fitted_rounds"] < 40 and info["fitted_rounds"] <= info["best_iteration"] + 4 + 4
    cut = GBTRegressor(seed=5, **{**BOOST, "maxIter": info["best_iteration"]}).fit(fit)
    mine, theirs = ([r["prediction"] for r in m.transform(held).collect()] for m in (model, cut))
    assert mine == pytest.approx(theirs, rel=1e-9)


def test_boosting_reproduces_and_is_stored(spark, tmp_path):
    fit, held = boosted_rows(spark, 300, 3), boosted_rows(spark, 100, 4)
    params = {**BOOST, "maxIter": 6, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"}
    a, b = (boosting.boost(fit, held, params, seed=9, patience=50, first_block=2) for _ in range(2))
    assert a[1] == b[1] and a[1]["fitted_rounds"] == 6 and a[0].toDebugString.split("\n")[1:] == b[0].toDebugString.split("\n")[1:]
    a[0].write().overwrite().save(str(tmp_path / "m"))
    back = GBTRegressionModel.load(str(tmp_path / "m"))
    assert [r["prediction"] for r in back.transform(held).collect()] == [r["prediction"] for r in a[0].transform(held).collect()]
    with pytest.raises(ValueError):
        boosting.boost(fit, held, params, seed=9, patience=0)


@pytest.mark.parametrize("side", ["high", "low", "apart"])
def test_missing_values_take_the_side_that_fits(spark, side):
    """NULL rows behave like large values, like small ones, or like neither."""
    rows = []
    for i in range(400):
        x = float(i % 100)
        y = {"high": float(x >= 50), "low": float(x < 50), "apart": 0.0}[side]
        rows.append((x, y) if i % 4 else (None, 5.0 if side == "apart" else 1.0))
    df = spark.createDataFrame(rows, "x double, y_true double")
    params = {"maxIter": 1, "maxDepth": 1, "maxBins": 128, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    model, _ = trees.fit_model(df, ["x"], params=params, target_transform="identity")
    assert trees.vector_names(model) == ["x", "x"]
    got = {r["x"]: r["y_pred"] for r in trees.predict(df, model, ["x"], target_transform="identity").collect()}
    assert got[None] == {"high": 1.0, "low": 1.0, "apart": 5.0}[side]
    assert [got[1.0], got[99.0]] == {"high": [0.0, 1.0], "low": [1.0, 0.0], "apart": [0.0, 0.0]}[side]


def test_small_holdout_falls_back_to_validation(spark, season):
    params = {"n_estimators": 3, "max_depth": 2}
    _, _, notes = train.score_trees(season, SEASON_FOLDS[:1], groups=["base", "calendar"], fit={"params": params, "patience": 2})
    assert [n["stopped_on"] for n in notes] == ["validation"]
    _, _, notes = train.score_trees(season, SEASON_FOLDS[:1], groups=["base", "calendar"], fit={"params": params, "patience": 2, "min_fit": 100, "min_holdout": 30})
    assert [n["stopped_on"] for n in notes] == ["holdout"]
    matrix = train.model_matrix(season, groups=["base"])
    with pytest.raises(ValueError, match="holdout"):
        train.fit_fold(matrix, day(105), model_columns(["base"]), params=params, patience=2)


def test_ordered_statistics_see_earlier_days_only(spark):
    rng = np.random.default_rng(8)
    rows = [(None if k == 3 else f"level {k}", day(int(d)), None if rng.random() < 0.1 else float(rng.normal())) for k in range(4) for d in rng.integers(0, 12, 20)]
    df = spark.createDataFrame(rows, "kind string, date date, y double").withColumn("_n", F.lit("clash")).repartition(3)
    got = stats.ordered_statistics(df.drop("_n"), ["kind"], F.col("y"), weight=4.0).collect()
    assert len(got) == len(rows)

    def expected(kind, when, history):
        past = [y for k, d, y in history if d < when and y is not None]
        mine = [y for k, d, y in history if d < when and y is not None and k == kind]
        prior = sum(past) / len(past) if past else 0.0
        return (sum(mine) + 4 * prior) / (len(mine) + 4)

    for r in got:
        assert r["kind_stat"] == pytest.approx(expected(r["kind"], r["date"], rows), abs=1e-12)
    # What happens from a day on changes nothing for the rows up to it.
    later = [(k, d, y if d < day(6) else 1e9) for k, d, y in rows]
    changed = stats.ordered_statistics(spark.createDataFrame(later, "kind string, date date, y double"), ["kind"], F.col("y"), weight=4.0)
    keys = lambda d: sorted((str(r["kind"]), r["date"], round(r["kind_stat"], 9)) for r in d if r["date"] <= day(6))
    assert keys(changed.collect()) == keys(got)
    new = spark.createDataFrame([("level 1",), (None,), ("unseen",)], "kind string")
    at_end = {r["kind"]: r["kind_stat"] for r in stats.origin_statistics(new, df, ["kind"], F.col("y"), weight=4.0).collect()}
    for kind in ("level 1", None, "unseen"):
        assert at_end[kind] == pytest.approx(expected(kind, day(99), rows))


def test_statistics_of_the_key_are_met_in_place(spark):
    rows = [(None if k == 2 else k, f"f{f}", day(d), float(k + d + f)) for k in range(3) for d in range(8) for f in range(2)]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, y double")
    made = stats.ordered_statistics(df, ["store_nbr", "family"], F.col("y"), weight=4.0)
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        past = [(s, f, y) for s, f, d, y in rows if d < r["date"]]
        prior = sum(y for *_, y in past) / len(past) if past else 0.0
        for i, c in enumerate(("store_nbr", "family")):
            mine = [p[2] for p in past if p[i] == r[c]]
            assert r[f"{c}_stat"] == pytest.approx((sum(mine) + 4 * prior) / (len(mine) + 4), abs=1e-12)


def test_linear_fits_store_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", day(i), float(i % 5), float(i % 5)) for i in range(40)],
                               "store_nbr int, family string, date date, x double, y_true double")
    _, vectors = train.encode_matrix(df, ["x"], "linear")
    assert not any("vectors-" in f for f in vectors.inputFiles()) and vectors.count() == 40


def test_raw_tables_are_compressed(spark, tmp_path):
    w = Warehouse(spark, "/root/testdata/sf0.001")
    tables.write_raw_tables({"oil": w.oil()}, str(tmp_path))
    assert list((tmp_path / "oil.csv").glob("*.csv.gz")) and not list((tmp_path / "oil.csv").glob("*.csv"))


def test_models_of_all_folds_and_seeds_grow_in_the_same_passes(spark, season, monkeypatch):
    """Each model is that of Spark's own fit on its rows, and no fit keeps or stores rows of its own."""
    cols = model_columns(["calendar", "promo"])
    matrix = train.model_matrix(season, groups=["calendar", "promo"])
    params = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3, "maxBins": 128, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    packed = train.pack_matrix(matrix, cols)
    monkeypatch.setattr(growth, "saved", None)
    passes = []
    counting = growth._counting
    monkeypatch.setattr(growth, "_counting", lambda *a: passes.append(1) or counting(*a))
    fits = train.fit_packed(packed, [train.Wanted(f.train_end, params, s) for f in SEASON_FOLDS for s in (1, 2)])
    assert len(passes) == 9 and len(fits) == 4
    for (model, info), f in zip(fits[::2], SEASON_FOLDS):
        rows = packed.rows.where(F.col("date") <= F.lit(f.train_end))
        vectors = trees.encoded(rows, cols, packed.encoder, F.log1p(F.greatest("y_true", F.lit(0.0))).alias("label"))
        whole = GBTRegressor(labelCol="label", **params).fit(vectors)
        mine, theirs = ([r["prediction"] for r in m.transform(vectors).collect()] for m in (model.stages[-1], whole))
        assert mine == pytest.approx(theirs, abs=1e-6) and len(set(mine)) > 8 and info["fitted_rounds"] == 3


def test_packed_models_draw_rows_and_stop_alike_wherever_the_rows_lie(spark, season):
    cols = model_columns(["base", "calendar"])
    matrix = train.model_matrix(season, groups=["base", "calendar"])
    params = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7", "minInstancesPerNode": 5}
    found = []
    for n in (1, 5):
        packed = train.pack_matrix(matrix.repartition(n), cols)
        model, info = train.fit_packed(packed, [train.Wanted(day(110), params, 9)], patience=2, min_fit=100, min_holdout=30)[0]
        assert 1 <= info["best_iteration"] <= info["fitted_rounds"] <= info["best_iteration"] + 2 and info["stopped_on"] == "holdout"
        assert len(info["errors"]) >= info["best_iteration"]
        found.append((info, model.stages[-1].toDebugString.split("\n")[1:]))
    assert found[0] == found[1]


def test_full_refit_takes_a_matrix_that_is_made(spark, season, monkeypatch):
    """The matrix is stored once, and a row's mark takes four bytes."""
    matrix = train.model_matrix(season, groups=["base", "calendar"])
    packed = []
    packing = train.pack_matrix
    monkeypatch.setattr(train, "pack_matrix", lambda *a: packed.append(packing(*a)) or packed[0])
    monkeypatch.setattr(predict, "model_matrix", None)
    model = predict.retrain_full(season, groups=["base", "calendar"], fit={"params": {"n_estimators": 1, "max_depth": 2}}, matrix=matrix)
    assert model.stages[-1].getNumTrees == 1
    assert {r[0] for r in packed[0].blocks.selectExpr("length(marks) * 2 = length(labels)").collect()} == {True}


def test_blocks_are_read_a_few_at_a_time(spark):
    """A reader takes in a row group at once, and a worker a batch: neither may hold all blocks of a task."""
    slots = [f"s{i}" for i in range(40)]
    rows = spark.range(0, 400_000, 1, 1).select(
        F.lit(7).alias("_day"), F.lit(1.0).alias("label"), F.col("id").alias("_mark"), *[F.rand(i).alias(s) for i, s in enumerate(slots)])
    cuts = [np.linspace(0.1, 0.9, 9)] * len(slots)
    blocks = growth.pack(rows, slots, cuts)
    sizes = []
    for file in blocks.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        sizes += [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert sum(sizes) > 20e6 and max(sizes) < 12e6
    growth.grow(blocks, cuts, [growth.Job(7, {"maxIter": 1, "stepSize": 0.1, "maxDepth": 1}, 1, tuple(range(40)))])
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == growth.BATCH


def test_tree_search_query_fits_every_trial_whole(spark, monkeypatch):
    """No trial is dropped after a few rounds, no size of the trees is fixed, and the holdout says how many there are."""
    asked = {}

    def search(panel, folds, path, **kw):
        asked.update(kw, folds=len(folds))
        raise KeyError("asked")

    monkeypatch.setattr(models, "run_search", search)
    with pytest.raises(KeyError):
        QUERIES["m5_nested_tree_search"](spark, "/root/testdata/sf0.001")
    assert not asked.get("rungs") and not asked.get("fixed") and asked["patience"] and asked["folds"] == 3
    assert set(asked["space"]) == set(tune.SPACES["leaves"]) and f"{asked['n_trials']} AS finalists" in ORACLES["m5_nested_tree_search"]


def test_prepare_moves_the_training_table_once(spark, season, tmp_path, monkeypatch):
    """Rows are dealt by ranges of the key and grouped there; of rows of a key the last in the file stays."""
    rows = season.withColumn("id", F.monotonically_increasing_id())
    twice = rows.unionByName(rows.withColumn("sales", F.col("sales") / 2)).coalesce(1)
    made = {
        "train": twice, "test": rows.limit(3), "sample_submission": rows.limit(3),
        "stores": spark.createDataFrame([(0, "c", "s", "A", 1)], "store_nbr int, city string, state string, type string, cluster int"),
        "oil": spark.createDataFrame([(day(0), 1.0)], "date date, dcoilwtico double"),
        "holidays_events": spark.createDataFrame([(day(0), "Holiday", "Local", "c", "d", False)],
                                                 "date date, type string, locale string, locale_name string, description string, transferred boolean"),
        "transactions": spark.createDataFrame([(day(0), 0, 5)], "date date, store_nbr int, transactions int"),
    }
    tables.write_raw_tables(made, str(tmp_path / "raw"))
    plans = []

    def write(cleaned, folder, layout, placed=()):
        keys = layout["train"]
        moved = cleaned["train"] if "train" in placed else cleaned["train"].repartitionByRange(*keys)
        plans.append(moved.sortWithinPartitions(*keys)._jdf.queryExecution().executedPlan().toString())
        tables.write_interim(cleaned, folder, layout, placed)

    monkeypatch.setattr(prepare, "write_interim", write)
    prepare.prepare(spark, str(tmp_path / "raw"), str(tmp_path / "interim"), str(tmp_path / "splits"), {"min_train_days": 30, "n_folds": 2})
    assert plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0]
    kept = spark.read.parquet(str(tmp_path / "interim" / "train.parquet"))
    assert kept.count() == rows.count()
    assert kept.agg(F.sum("sales")).first()[0] == pytest.approx(rows.agg(F.sum("sales")).first()[0] / 2)
