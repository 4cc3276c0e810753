"""Operators on hand-built frames with hand-computed results."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import column, day, panel
from tidepanel.catalog.registry import tidy
from tidepanel.functions import scalars as S
from tidepanel.functions.metrics import rmsle
from tidepanel.functions.quantiles import exact_quantiles
from tidepanel.operators import clean, contracts, explore, masks, naive, splits, stress
from tidepanel.operators import evaluation as ev
from tidepanel.operators import features as X
from tidepanel.operators.blend import align_oofs, mean_blend, nonneg_weights, weighted_blend
from tidepanel.operators.panel import fold_matrices, fold_matrix, train_test_panel
from tidepanel.operators.search import best_trial, sample_trials
from tidepanel.sources import schemas, tables
from tidepanel.sources.tables import INPUT_ORDER, with_input_order
from tidepanel.sources.warehouse import Warehouse

KEYS = ["store_nbr", "family", "date"]


def oil(spark, rows):
    return spark.createDataFrame(
        [(dt.date(2017, 1, d), v, i) for i, (d, v) in enumerate(rows)], "date date, dcoilwtico double, seq int")


# --- contracts and cleaning --------------------------------------------------
def test_required_columns(tiny_panel):
    with pytest.raises(ValueError, match="id"):
        schemas.validate_train_schema(tiny_panel)
    ok = tiny_panel.withColumn("id", F.lit(1)).withColumn("more", F.lit(2))
    assert schemas.validate_train_schema(ok) is ok
    assert schemas.validate_test_schema(ok.drop("sales"))


def test_oil_fill_interior_duplicates_and_leading(spark):
    assert column(clean.clean_oil(oil(spark, [(1, 50.0), (2, None), (3, 52.0)]), order_by="seq"), "dcoilwtico") == [50, 50, 52]
    dup = clean.clean_oil(oil(spark, [(3, 52.0), (1, 49.0), (1, 50.0)]), order_by="seq")
    assert column(dup, "dcoilwtico") == [50, 52]
    assert column(clean.clean_oil(oil(spark, [(1, None), (2, 50.0), (3, None)]), order_by="seq"), "dcoilwtico") == [None, 50, 50]


def test_invalid_flag_and_guard(spark):
    df = panel(spark, [0, 1.5, -0.1, 10])
    assert column(clean.flag_invalid_sales(df), "is_invalid") == [False, False, True, False]
    with pytest.raises(Exception, match="negative sales"):
        clean.assert_nonnegative(df).collect()
    assert clean.assert_nonnegative(df.where("sales >= 0")).count() == 3


def test_keep_one_needs_no_row_order(spark):
    rows = [(1, i, i * 10) for i in range(50)] + [(2, 7, 70)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, seq int, v int").repartition(7)
    last = {r["k"]: r["v"] for r in clean.keep_one(df, ["k"], "seq").collect()}
    first = {r["k"]: r["v"] for r in clean.keep_one(df, ["k"], "seq", keep="first").collect()}
    assert last == {1: 490, 2: 70} and first == {1: 0, 2: 70}


def test_densify_fills_gaps_from_start_to_end(spark):
    df = panel(spark, [5]).union(panel(spark, [7], start="2017-01-04")).union(panel(spark, [1], family="B", start="2017-01-02"))
    out = clean.densify(df, entity_cols=["store_nbr", "family"], date_col="date", start="2016-12-31", end="2017-01-05",
                        fill={"sales": 0.0, "onpromotion": 0})
    assert column(out.where("family = 'A'"), "sales") == [0, 5, 0, 0, 7, 0]
    assert column(out.where("family = 'B'"), "sales") == [0, 0, 1, 0, 0, 0]


def test_parse_dates(spark):
    df = spark.createDataFrame([("2017-01-01",), ("nonsense",)], "date string")
    from tidepanel.sources.tables import parse_dates

    assert [r[0] for r in parse_dates(df, strict=False).collect()] == [dt.date(2017, 1, 1), None]
    with pytest.raises(Exception):
        parse_dates(df).collect()


# --- scalars -----------------------------------------------------------------
def test_coercion_clip_and_transform(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,), ("NaN",), ("-2",)], "v string")
    assert [r[0] for r in df.select(S.to_number("v")).collect()] == [3.0, None, None, None, -2.0]
    assert [r[0] for r in df.select(S.clip(S.to_number("v"), lower=0.0)).collect()] == [3.0, None, None, None, 0.0]
    back = df.select(S.inverse_target(S.transform_target(S.to_number("v")))).collect()
    assert back[0][0] == pytest.approx(3.0) and back[4][0] == 0.0
    with pytest.raises(ValueError):
        S.transform_target("v", "cube")
    promo = X.add_promo_features(df.withColumnRenamed("v", "onpromotion")).collect()
    assert [r["has_promotion"] for r in promo] == [1, 0, 0, 0, 0]
    assert promo[1]["onpromotion_log1p"] == 0.0


# --- splits ------------------------------------------------------------------
def test_expanding_folds_order_gap_and_errors(tiny_panel):
    folds = splits.collect_folds(splits.expanding_folds(tiny_panel, n_folds=3, val_days=5, gap_days=2, min_train_days=10))
    assert [f.fold for f in folds] == [0, 1, 2]
    assert folds[-1].val_end == day(39) and folds[-1].val_start == day(35) and folds[-1].train_end == day(32)
    assert all((f.val_start - f.train_end).days > 2 for f in folds)
    report = splits.leakage_report(tiny_panel, folds, gap_days=2).collect()
    assert all(r["is_safe"] for r in report)
    short = splits.expanding_folds(tiny_panel, n_folds=9, val_days=5, gap_days=0, min_train_days=20)
    assert short.count() == 4
    with pytest.raises(ValueError):
        splits.collect_folds(splits.expanding_folds(tiny_panel, n_folds=1, val_days=5, min_train_days=365))
    with pytest.raises(ValueError):
        splits.expanding_folds(tiny_panel, n_folds=0)
    with pytest.raises(KeyError):
        splits.expanding_folds(tiny_panel, date_col="when")


def test_folds_count_unique_dates_not_calendar_days(spark):
    df = panel(spark, range(30)).where("weekday(date) < 5")
    f = splits.collect_folds(splits.expanding_folds(df, n_folds=1, val_days=5, min_train_days=1))[0]
    dates = sorted(r["date"] for r in df.collect())
    assert (f.val_start, f.val_end, f.train_end) == (dates[-5], dates[-1], dates[-6])


def test_last_block(tiny_panel):
    inner = splits.last_block(tiny_panel, val_days=7, gap_days=3)
    assert (inner.train_end, inner.val_start, inner.val_end) == (day(29), day(33), day(39))
    with pytest.raises(ValueError, match="insufficient"):
        splits.last_block(tiny_panel.where(F.col("date") < F.lit(day(6))), val_days=10)
    outer = splits.Fold(0, day(39), day(40), day(45))
    assert splits.is_nested(inner, outer) and not splits.is_nested(outer, inner)


def test_expand_folds_roles(tiny_panel):
    folds = splits.collect_folds(splits.expanding_folds(tiny_panel, n_folds=2, val_days=5, gap_days=1, min_train_days=5))
    got = {(r["fold"], r["role"]): r["n"] for r in
           splits.expand_folds(tiny_panel, folds).groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "train"): 58, (0, "gap"): 2, (0, "val"): 10, (1, "train"): 68, (1, "gap"): 2, (1, "val"): 10}


# --- features and leakage ----------------------------------------------------
def test_lags_and_rolling_look_back_only(spark):
    df = panel(spark, [10, 20, 30, 40, 50, 60])
    assert column(X.add_lag_features(df, lags=(1,)), "sales_lag_1") == [None, 10, 20, 30, 40, 50]
    roll = X.add_rolling_features(df, windows=(3,), stats=("mean", "std"))
    assert column(roll, "sales_roll_mean_3") == [None, 10, 15, 20, 30, 40]
    assert column(roll, "sales_roll_std_3")[:2] == [None, None] and column(roll, "sales_roll_std_3")[3] == pytest.approx(10)
    least = X.add_rolling_features(df, windows=(3,), stats=("mean",), min_periods=3)
    assert column(least, "sales_roll_mean_3") == [None, None, None, 20, 30, 40]
    assert X.add_lag_features(df, lags=()) is df
    for bad in ({"lags": (0,)},):
        with pytest.raises(ValueError):
            X.add_lag_features(df, **bad)
    with pytest.raises(ValueError):
        X.add_rolling_features(df, shift=0)


def test_rolling_statistics_come_from_blocks_and_lose_no_digits(spark):
    rng = random.Random(3)
    values = [None if rng.random() < 0.2 else 1e9 + rng.randrange(5) if i < 40 else rng.random() for i in range(90)]
    df = panel(spark, values)
    for windows, shift, least in (((7, 14, 28), 1, 1), ((28,), 2, 5), ((5, 11), 1, 2), ((1, 6), 3, 1)):
        made = X.add_rolling_features(df, windows=windows, shift=shift, min_periods=least).orderBy("date").collect()
        for i, row in enumerate(made):
            for w in windows:
                seen = [v for v in values[max(0, i - shift - w + 1):max(0, i - shift + 1)] if v is not None]
                mean, std = row[f"sales_roll_mean_{w}"], row[f"sales_roll_std_{w}"]
                assert mean == (pytest.approx(np.mean(seen), rel=1e-12) if len(seen) >= least else None)
                assert std == (pytest.approx(np.std(seen, ddof=1), rel=1e-6, abs=1e-9) if len(seen) >= max(2, least) else None)
    plan = X.add_rolling_features(df)._jdf.queryExecution().executedPlan().toString()
    frames = {(int(a), int(b)) for a, b in re.findall(r"RowFrame, (-?\d+), (-?\d+)", plan)}
    assert frames and all(a == b for a, b in frames) and max(-a for a, _ in frames) <= 28


def test_lags_are_row_positional_on_gaps(spark):
    df = panel(spark, [1, 2, 3, 4]).where("day(date) <> 3")
    assert column(X.add_lag_features(df, lags=(1,)), "sales_lag_1") == [None, 1, 2]


def test_doubles_are_rounded_half_away_from_zero(spark):
    values = [0.0078125, -0.0078125, 1.0000005, 2.5, -0.0, 1e300, float("nan"), None, 123456789.1234567, -1e-9, 3e9 + 0.25]
    made = tidy(spark.createDataFrame([(v,) for v in values], "v double"))
    got = [r["v"] for r in made.collect()]
    assert got[:6] == [0.007813, -0.007813, 1.000001, 2.5, 0.0, 1e300] and math.isnan(got[6]) and got[7] is None
    assert got[8:] == [123456789.123457, 0.0, 3e9 + 0.25] and all(math.copysign(1, got[i]) == 1 for i in (4, 9))


def test_results_survive_shuffled_input(tiny_panel):
    shuffled = tiny_panel.orderBy(F.rand(5)).repartition(9)
    for fn in (lambda d: X.add_rolling_features(X.add_lag_features(d)), lambda d: explore.entity_summary(d)):
        assert sorted(map(str, fn(tiny_panel).collect())) == sorted(map(str, fn(shuffled).collect()))


def test_oil_lag_is_previous_quote(spark):
    quotes = oil(spark, [(1, 50.0), (2, 60.0), (3, 70.0)])
    made = X.add_oil_features(panel(spark, [1, 1, 1]), quotes)
    assert column(made, "oil_lag_1") == [None, 50, 60]
    gap = X.add_oil_features(panel(spark, [1] * 4), oil(spark, [(1, 50.0), (4, 60.0)]))
    assert column(gap, "oil_lag_1") == [None, None, None, 50]
    with pytest.raises(ValueError):
        X.oil_features(quotes, lag=0)


def test_transaction_features_and_mask(spark):
    tx = spark.createDataFrame([(day(i), 1, v) for i, v in enumerate([100, 200, 300])], "date date, store_nbr int, transactions int")
    made = X.add_transaction_features(panel(spark, [1, 1, 1]), tx, windows=(2,))
    assert column(made, "transactions_lag_1") == [None, 100, 200]
    assert column(made, "transactions_roll_mean_2")[2] == 150
    masked = masks.mask_outcome_extras_after({"transactions": tx, "oil": tx}, day(1))
    assert column(masked["transactions"], "transactions") == [100, 200, None]
    assert column(masked["transactions"], "store_nbr") == [1, 1, 1]
    assert masked["oil"] is tx
    ahead = X.extend_transactions(tx, panel(spark, [0] * 5).select("date", "store_nbr"))
    assert column(X.transaction_features(ahead), "transactions_lag_1") == [None, 100, 200, 300, None]


def test_holiday_quirks(spark):
    hol = spark.createDataFrame(
        [(day(0), "Work Day", "National", "Country", "x", False), (day(1), "Holiday", "National", "Country", "x", True),
         (day(2), "Holiday", "Local", "Here", "x", False), (day(3), "Bridge", "Regional", "West", "x", False)],
        "date date, type string, locale string, locale_name string, description string, transferred boolean")
    stores = spark.createDataFrame([(1, "Here", "East", "A", 1), (2, "There", "West", "B", 2)],
                                   "store_nbr int, city string, state string, type string, cluster int")
    two = panel(spark, [1] * 4).union(panel(spark, [1] * 4, store=2))
    made = X.add_holiday_features(two, hol, stores)
    one, other = made.where("store_nbr = 1"), made.where("store_nbr = 2")
    assert column(one, "is_national_holiday") == [1, 0, 0, 0] and column(one, "is_work_day") == [1, 0, 0, 0]
    assert column(one, "is_local_holiday") == [0, 0, 1, 0] and column(other, "is_local_holiday") == [0, 0, 0, 0]
    assert column(other, "is_regional_holiday") == [0, 0, 0, 1] and column(one, "is_holiday") == [1, 0, 1, 0]
    assert column(one, "is_bridge") == [0, 0, 0, 1]
    plain = X.add_holiday_features(two, hol)
    assert plain.agg(F.sum("is_local_holiday") + F.sum("is_regional_holiday")).first()[0] == 0


def test_store_meta_replaces_columns(spark):
    stores = spark.createDataFrame([(1, "c", "s", "A", 3)], "store_nbr int, city string, state string, type string, cluster int")
    made = X.add_store_meta_features(panel(spark, [1]).withColumn("city", F.lit("old")), stores).first()
    assert (made["city"], made["store_type"], made["cluster"]) == ("c", "A", 3)


def test_registry_and_ablation_order():
    assert X.feature_columns(["base", "promo"]) == ["store_nbr", "family", "onpromotion", "onpromotion_log1p", "has_promotion"]
    assert len(X.feature_columns(X.CORE_GROUPS)) == 22
    with pytest.raises(ValueError):
        X.feature_columns(["nope"])
    plan = X.ablation_group_sets()
    assert len(plan) == 9 and plan[0] == ["base"] and plan[4] == list(X.CORE_GROUPS) and plan[-1][-1] == "transactions"
    assert X.ablation_group_sets(["base", "oil"]) == [["base"], ["base", "oil"]]
    assert X.groups_with_flags({"oil": True}) == [*X.CORE_GROUPS, "oil"]
    assert X.needs_recursion(["lag"]) and not X.needs_recursion(["calendar"])


def test_matrix_needs_its_tables(spark):
    with pytest.raises(ValueError, match="oil"):
        X.build_feature_matrix(panel(spark, [1]), groups=["oil"])
    with pytest.raises(ValueError, match="sales"):
        X.build_feature_matrix(panel(spark, [1]).drop("sales"), groups=["lag"])


def test_origin_mask_hides_future_from_lags(spark):
    df = panel(spark, [10, 20, 30, 40, 50, 60])
    made = X.add_lag_features(masks.mask_target_after(df, day(2)), lags=(1,))
    assert column(made, "sales")[3:] == [None] * 3
    assert column(made, "sales_lag_1") == [None, 10, 20, 30, None, None]


def test_fold_matrix_keeps_labels(spark):
    df = panel(spark, [100 + i for i in range(20)])
    fold = splits.Fold(0, day(9), day(10), day(14))
    tx = spark.createDataFrame([(day(i), 1, 500 + i) for i in range(16)], "date date, store_nbr int, transactions int")
    val = fold_matrix(df, fold, groups=["lag", "transactions"], extras={"transactions": tx}).where("role = 'val'")
    assert column(val, "y_true") == [110, 111, 112, 113, 114]
    assert column(val, "sales_lag_1") == [109, None, None, None, None]
    assert column(val, "transactions_lag_1") == [509, None, None, None, None]


def test_fold_matrices_hold_every_row_of_every_fold(spark):
    df = panel(spark, [100 + i * i % 37 for i in range(70)]).unionByName(panel(spark, [3 * i % 11 for i in range(70)], family="B"))
    folds = [splits.Fold(k, day(49 + 8 * k), day(50 + 8 * k), day(57 + 8 * k)) for k in range(2)]
    tx = spark.createDataFrame([(day(i), 1, 500 + i) for i in range(70)], "date date, store_nbr int, transactions int")
    args = {"groups": ["base", "lag", "rolling", "transactions"], "extras": {"transactions": tx}}
    made = fold_matrices(df, folds, **args)
    alone = fold_matrix(df, folds[0], **args).unionByName(fold_matrix(df, folds[1], **args)).select(*made.columns)
    assert made.count() == 2 * (58 + 66)
    assert sorted(map(str, made.collect())) == sorted(map(str, alone.collect()))


def test_filled_panel_is_neither_broadcast_nor_moved(spark):
    w = Warehouse(spark, "/root/testdata/sf0.001")
    assert "BuildLeft" not in w.with_id(w.panel())._jdf.queryExecution().executedPlan().toString()
    lagged = X.add_lag_features(w.panel()).join(w.panel().select(*KEYS, "sales").hint("shuffle_hash"), KEYS, "left")
    assert "hashpartitioning" not in lagged._jdf.queryExecution().executedPlan().toString()


def test_write_back_sends_no_forecast_table_to_every_task(spark):
    df = panel(spark, [1, 2, 3])
    preds = df.where(F.col("date") == F.lit(day(2))).select(*KEYS, F.lit(9.0).alias("y_pred"))
    plan = masks.write_back(df, preds)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan


def test_categories_unseen(spark):
    train, new = panel(spark, [1], "B").union(panel(spark, [1], "A")), panel(spark, [1], "C").union(panel(spark, [1], "B"))
    assert {r["family"]: r["family_code"] for r in X.encode_levels(new, train, ["family"]).collect()} == {"B": 1, "C": None}
    assert {r["family"]: r["family_code"] for r in X.encode_levels(new, train, ["family"], unseen=-1).collect()} == {"B": 1, "C": -1}


def test_write_back_and_train_test_panel(spark):
    df = panel(spark, [1, 2, 3])
    preds = df.where(F.col("date") == F.lit(day(2))).select(*KEYS, F.lit(9.0).alias("y_pred"))
    assert column(masks.write_back(df, preds), "sales") == [1, 2, 9]
    assert column(masks.fill_from_oof(df, preds, day(0)), "sales") == [1, None, 9]
    both = train_test_panel(df, panel(spark, [5], start="2017-01-04"))
    assert column(both, "sales") == [1, 2, 3, None]
    with pytest.raises(ValueError):
        train_test_panel(df.drop("sales"), df)


# --- naive forecasts ---------------------------------------------------------
def test_last_value_and_seasonal(spark):
    df = panel(spark, range(25))
    hist, fut = df.where(F.col("date") < F.lit(day(10))), df.where(F.col("date") >= F.lit(day(10)))
    assert set(column(naive.last_value_predict(hist, fut), "y_pred")) == {9.0}
    pred = dict(zip(column(fut, "date"), column(naive.seasonal_naive_predict(hist, fut, period=7), "y_pred")))
    assert pred[day(10)] == 3.0 and pred[dt.date(2017, 1, 18)] == 3.0
    with pytest.raises(ValueError):
        naive.seasonal_naive_predict(hist, fut, period=0)
    stranger = panel(spark, [0], family="Z", start="2017-01-12")
    assert column(naive.last_value_predict(hist, stranger), "y_pred") == [0.0]
    gappy = hist.withColumn("sales", F.when(F.col("date") < F.lit(day(9)), F.col("sales")))
    assert set(column(naive.last_value_predict(gappy, fut), "y_pred")) == {8.0}


def test_all_folds_at_once_equals_fold_by_fold(tiny_panel):
    noisy = tiny_panel.withColumn("sales", (F.abs(F.xxhash64("family", "date")) % 97).cast("double")).where("day(date) % 4 <> 0 or family = 'A'")
    folds = splits.collect_folds(splits.expanding_folds(noisy, n_folds=2, val_days=9, min_train_days=5))
    wide = naive.naive_oof(noisy, folds, periods=(7,))
    for f in folds:
        hist = noisy.where(F.col("date") <= F.lit(f.train_end))
        fut = noisy.where(F.col("date").between(f.val_start, f.val_end))
        one = naive.seasonal_naive_predict(hist, fut, period=7, train_end=f.train_end).select(*KEYS, "y_pred")
        got = wide.where(F.col("fold") == f.fold).select(*KEYS, F.col("seasonal_naive_7").alias("y_pred"))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, got.collect()))


# --- metrics and evaluation --------------------------------------------------
def oof(spark):
    rows = [(1, fam, day(k, s), f, y, p) for f, s in ((0, "2017-07-02"), (1, "2017-07-17")) for k in range(3)
            for fam, y, p in (("A", 1.0, 1.0), ("B", 4.0, 2.0))]
    return spark.createDataFrame(rows, "store_nbr int, family string, date date, fold int, y_true double, y_pred double")


FOLDS = [splits.Fold(0, dt.date(2017, 7, 1), dt.date(2017, 7, 2), dt.date(2017, 7, 4)),
         splits.Fold(1, dt.date(2017, 7, 16), dt.date(2017, 7, 17), dt.date(2017, 7, 19))]


def test_rmsle_value_and_empty(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")
    assert df.agg(rmsle("y", "p")).first()[0] == pytest.approx(math.sqrt((math.log(5) - math.log(4)) ** 2 / 3))
    assert df.agg(rmsle("y", "y")).first()[0] == 0.0
    with pytest.raises(Exception, match="zero rows"):
        df.where("false").agg(rmsle("y", "p")).collect()


def test_fold_horizon_segment_metrics(spark):
    df = oof(spark)
    table = ev.fold_metrics(df).collect()
    assert sorted((r["fold"] is None, r["n"]) for r in table) == [(False, 6), (False, 6), (True, 12)]
    s = ev.summarize_folds(ev.fold_metrics(df)).first()
    err = math.log(3) - math.log(5)
    assert s["mean_rmsle"] == pytest.approx(abs(err) / math.sqrt(2)) and s["std_rmsle"] == pytest.approx(0)
    assert s["mean_bias_log1p"] == pytest.approx(err / 2) and s["n_oof"] == 12 and s["n_folds"] == 2
    assert ev.summarize_folds(ev.fold_metrics(df.where("fold = 0"))).first()["std_rmsle"] == 0.0
    h = ev.horizon_metrics(ev.annotate_horizon(df, FOLDS)).orderBy("horizon").collect()
    assert [(r["horizon"], r["n"]) for r in h] == [(1, 4), (2, 4), (3, 4)]
    seg = ev.segment_metrics(df, by="family", min_n=1).collect()
    assert [r["segment"] for r in seg] == ["B", "A"]
    assert ev.segment_metrics(df, by="family", min_n=7).count() == 0
    with pytest.raises(ValueError):
        ev.horizon_metrics(df)


def test_gate(spark):
    df = spark.createDataFrame([(0.39,), (0.60,)], "mean_rmsle double")
    assert [r["go_no_go"] for r in ev.gate_vs_naive(df).orderBy("mean_rmsle").collect()] == ["GO", "NO_GO"]


# --- quantiles, exploration --------------------------------------------------
def test_exact_quantiles_under_skew(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.zeros(3000), rng.lognormal(0, 2, 4000), np.full(800, 7.5)])
    groups = ["hot" if i % 3 else "cold" for i in range(len(values))]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)], "g string, v double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, "v", probs, rows_per_range=250).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    by = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, "v", probs, ["g"], rows_per_range=250).collect()}
    for g in ("hot", "cold"):
        part = values[[x == g for x in groups]]
        for p in probs:
            assert by[g, p] == pytest.approx(np.quantile(part, p), rel=1e-12)


def test_seeded_sample_is_stable(tiny_panel):
    a = explore.seeded_sample(tiny_panel, 10, KEYS, 1).collect()
    b = explore.seeded_sample(tiny_panel.repartition(11), 10, KEYS, 1).collect()
    assert a == b and len(a) == 10
    assert explore.sampled_entities(tiny_panel, 1).count() == 40


def test_missing_gaps(spark):
    rows = explore.missing_gaps(oil(spark, [(1, 1.0), (2, None), (3, None), (4, 2.0), (5, None)]), "dcoilwtico").orderBy("gap_start").collect()
    assert [(r["gap_start"].day, r["gap_end"].day, r["n_quotes"]) for r in rows] == [(2, 3, 2), (5, 5, 1)]


# --- blends ------------------------------------------------------------------
def test_blend_weights_recover_mixture(spark):
    rng = np.random.default_rng(0)
    p0, p1 = rng.gamma(2, 5, 200), rng.gamma(2, 5, 200)
    y = 0.7 * p0 + 0.3 * p1 + rng.normal(0, 0.01, 200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, p0, p1, -p0)], "y_true double, a double, b double, c double")
    w = nonneg_weights(df, ["a", "b", "c"])
    assert w[:2] == pytest.approx([0.7, 0.3], abs=0.01) and w[2] == 0.0 and sum(w) == pytest.approx(1)
    assert nonneg_weights(df, ["c"]) == [1.0]
    row = df.select(mean_blend(["a", "b"]).alias("m"), weighted_blend(["a", "b"], [2, 2]).alias("w"), ((F.col("a") + F.col("b")) / 2).alias("x")).first()
    assert row["m"] == pytest.approx(row["x"]) and row["w"] == pytest.approx(row["x"])
    for bad in (([], []), (["a"], [1, 2]), (["a"], [0])):
        with pytest.raises(ValueError):
            weighted_blend(*bad)


def test_align_oofs_inner_and_unique(spark):
    df = oof(spark)
    out = align_oofs({"m1": df, "m2": df.where("fold = 0")})
    assert out.count() == 6 and set(out.columns) >= {"m1", "m2", "y_true"}
    with pytest.raises(Exception, match="more than once"):
        align_oofs({"m1": df.union(df), "m2": df}).collect()


# --- search ------------------------------------------------------------------
def test_trials_are_reproducible_and_bounded(spark):
    space = {"lr": {"type": "log_float", "low": 0.01, "high": 0.1}, "n": {"type": "int", "low": 3, "high": 5},
             "kind": {"type": "categorical", "choices": ["a", "b"]}}
    one = sample_trials(spark, space, 64, 7).orderBy("trial").collect()
    assert one == sample_trials(spark, space, 64, 7).repartition(5).orderBy("trial").collect()
    assert all(0.01 <= r["lr"] <= 0.1 for r in one)
    assert {r["n"] for r in one} == {3, 4, 5} and {r["kind"] for r in one} == {"a", "b"}
    scored = sample_trials(spark, space, 64, 7).withColumn("value", F.abs(F.col("lr") - one[9]["lr"]))
    assert best_trial(scored, ["lr"]).first()["trial"] == 9
    with pytest.raises(ValueError):
        sample_trials(spark, {"x": {"type": "odd", "low": 0, "high": 1}}, 2)


# --- stress ------------------------------------------------------------------
def test_noise_nulls_clip(tiny_panel):
    noisy = stress.relative_noise(tiny_panel, ["sales", "absent"], relative=0.1, seed=3)
    again = stress.relative_noise(tiny_panel.repartition(7), ["sales"], relative=0.1, seed=3)
    assert sorted(map(tuple, noisy.collect())) == sorted(map(tuple, again.collect()))
    assert stress.predictions_changed(tiny_panel, noisy, keys=KEYS, pred_col="sales").first()["changed"]
    same = stress.relative_noise(tiny_panel, ["sales"], relative=0.0)
    assert not stress.predictions_changed(tiny_panel, same, keys=KEYS, pred_col="sales").first()["changed"]
    with pytest.raises(ValueError):
        stress.relative_noise(tiny_panel, ["sales"], relative=-1)
    assert stress.null_columns(tiny_panel, ["sales"]).where("sales is not null").count() == 0
    fewer = stress.predictions_changed(tiny_panel, tiny_panel.limit(3), keys=KEYS, pred_col="sales")
    assert fewer.first()["changed"]


def test_clip_spikes(spark):
    df = panel(spark, [1, 2, 3, 1000, None])
    out = column(stress.clip_spikes(df, ["sales"], upper=0.75), "sales")
    assert out == [1, 2, 3, pytest.approx(np.quantile([1, 2, 3, 1000], 0.75)), None]
    with pytest.raises(ValueError):
        stress.clip_spikes(df, ["sales"], upper=0.2, lower=0.5)


# --- submission --------------------------------------------------------------
def sub(spark, rows):
    return spark.createDataFrame(rows, "id bigint, sales double")


def test_submission_contract(spark):
    sample = sub(spark, [(1, 0.0), (2, 0.0)])
    contracts.validate_submission(sub(spark, [(2, 1.0), (1, 3.0)]), sample)
    for rows, text in (([(1, 1.0)], "row count"), ([(1, 1.0), (3, 1.0)], "id set"),
                       ([(1, 1.0), (2, float("nan"))], "finite"), ([(1, 1.0), (2, float("inf"))], "finite")):
        with pytest.raises(ValueError, match=text):
            contracts.validate_submission(sub(spark, rows), sample)
    with pytest.raises(ValueError, match="missing"):
        contracts.validate_submission(sample.drop("sales"), sample)
    aligned = contracts.align_submission(sub(spark, [(9, 9.0), (2, 5.0)]), sample)
    assert column(aligned, "sales", "id") == [None, 5.0]
    with pytest.raises(Exception, match="not unique"):
        contracts.align_submission(sub(spark, [(1, 9.0), (1, 5.0)]), sample).collect()
    with pytest.raises(ValueError, match="duplicate"):
        contracts.require_unique(sub(spark, [(1, 9.0), (1, 5.0)]), ["id"])


def test_scores_are_null_when_a_row_has_no_error(spark):
    from tidepanel.functions.metrics import invalid_rows, score_columns

    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 5.0, None), ("b", 3.0, -2.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0)], "m string, y_true double, y_pred double")
    got = {r.m: r for r in df.groupBy("m").agg(*score_columns(), invalid_rows("y_true", "y_pred").alias("bad")).collect()}
    assert [got[m].rmsle for m in "ab"] == [None, None] and [got[m].mae_log1p for m in "ab"] == [None, None]
    assert [got[m].bad for m in "abc"] == [1, 1, 0] and got["c"].rmsle is not None


def test_unknown_model_parameters_raise_and_known_ones_are_listed():
    from tidepanel.operators import trees

    with pytest.raises(ValueError):
        trees.spark_params({"learning_rat": 0.1})
    assert trees.ignored_params({"reg_alpha": 1.0, "eta": 0.1, "num_leaves": 7}) == ["reg_alpha"]


def test_weights_of_many_members(spark):
    from tidepanel.operators.blend import nonneg_weights

    rows = [tuple(float((i * (k + 3)) % (7 + k)) for k in range(15)) for i in range(80)]
    rows = [(*r, 0.6 * r[2] + 0.4 * r[9]) for r in rows]
    names = [f"m{k}" for k in range(15)]
    w = nonneg_weights(spark.createDataFrame(rows, [*names, "y_true"]), names)
    assert min(w) >= 0 and sum(w) == pytest.approx(1) and w[2] == pytest.approx(0.6, abs=1e-6) and w[9] == pytest.approx(0.4, abs=1e-6)


def test_level_codes_of_a_million_levels(spark):
    n = 1_000_000
    levels = spark.range(n, numPartitions=8).select(F.sha2(F.col("id").cast("string"), 256).alias("kind"))
    codes = X.level_codes(levels, "kind", rows_per_range=100_000)
    assert not [e for e in codes._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in e and "kind" in e]
    got = codes.agg(F.count("*").alias("n"), F.min("kind_code").alias("lo"), F.max("kind_code").alias("hi"), F.count_distinct("kind_code").alias("d")).first()
    assert tuple(got) == (n, 0, n - 1, n)
    pairs = codes.where("kind_code % 1000 = 0").orderBy("kind_code").collect()
    assert [r["kind"] for r in pairs] == sorted(r["kind"] for r in pairs)


def test_seasonal_lookup_on_gaps(spark):
    days = [0, 1, 7, 8, 9, 15, 30, 37]
    df = spark.createDataFrame([(s, "A", day(d), float(d + 100 * s)) for s in (1, 2) for d in days], "store_nbr int, family string, date date, sales double")
    got = {(r["store_nbr"], r["date"]): r["seasonal"] for r in naive.seasonal_lookup(df, 7).collect()}
    assert got == {(s, day(d)): float(d - 7 + 100 * s) if d - 7 in days else None for s in (1, 2) for d in days}
    assert "Join" not in naive.seasonal_lookup(df, 7)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        naive.seasonal_lookup(df, 0)


def test_column_profile_counts_without_exploding(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, None, None), (2, "a", None)], "k int, t string, v double")
    for made in (explore.column_profile(df), explore.column_profile(df, approximate=True)):
        got = {r["column_name"]: (r["dtype"], r["n_unique"], r["n_missing"]) for r in made.collect()}
        assert got == {"k": ("int", 2, 0), "t": ("string", 1, 1), "v": ("double", 1, 2)}
        assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_spikes_are_clipped_by_group(spark):
    df = spark.createDataFrame([(f, float(v)) for f, vs in ((0, range(101)), (1, range(0, 1010, 10))) for v in vs], "fold int, x double")
    made = stress.clip_spikes(df, ["x"], upper=0.9, by=["fold"])
    assert {r["fold"]: r["m"] for r in made.groupBy("fold").agg(F.max("x").alias("m")).collect()} == {0: 90.0, 1: 900.0}


def test_order_of_submitted_ids(spark, tmp_path):
    ids = list(range(0, 900, 3))
    sub = spark.createDataFrame([(i, 1.0) for i in ids], "id long, sales double")
    path = str(tmp_path / "s")
    sub.repartitionByRange(5, "id").sortWithinPartitions("id").write.option("header", True).csv(path)
    back = with_input_order(spark.read.schema("id bigint, sales double").option("header", True).csv(path))
    sample = sub.withColumn("at", F.col("id"))
    contracts.validate_order(back, sample, INPUT_ORDER, "at")
    swapped = sample.withColumn("at", F.when(F.col("id") == 3, 6).when(F.col("id") == 6, 3).otherwise(F.col("id")))
    assert contracts.order_mismatches(back, swapped, INPUT_ORDER, "at").first()[0] == 2
    with pytest.raises(ValueError, match="2 submission ids"):
        contracts.validate_order(back, swapped, INPUT_ORDER, "at")
    missing = sample.where("id <> 897")
    assert contracts.order_mismatches(back, missing, INPUT_ORDER, "at").first()[0] == 1


def test_store_sides_meet_the_panel_in_one_join_spread_by_day(spark, tmp_path):
    rows = [(st, f, day(d), float(d % 5 + st), 0) for st in (1, 2, 3) for f in "ABC" for d in range(20)]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, sales double, onpromotion int")
    extras = {
        "stores": spark.createDataFrame([(s, f"c{s}", f"s{s % 2}", "A", s) for s in (1, 2)], "store_nbr int, city string, state string, type string, cluster int"),
        "holidays_events": spark.createDataFrame(
            [(day(3), "Holiday", "Local", "c1", "d", False), (day(4), "Bridge", "Regional", "s0", "d", False), (day(5), "Transfer", "National", "x", "d", True)],
            "date date, type string, locale string, locale_name string, description string, transferred boolean"),
        "transactions": spark.createDataFrame([(day(d), s, 10 * d + s) for d in range(20) for s in (1, 3)], "date date, store_nbr int, transactions int"),
    }
    groups = ["base", "lag", "holiday", "store_meta", "transactions"]
    made = X.build_feature_matrix(df, groups=groups, extras=extras)
    one_by_one = X.add_transaction_features(
        X.add_store_meta_features(X.add_holiday_features(X.add_lag_features(df), extras["holidays_events"], extras["stores"]), extras["stores"]), extras["transactions"])
    cols = sorted(one_by_one.columns)
    assert sorted(made.columns) == cols
    assert sorted(map(str, made.select(cols).collect())) == sorted(map(str, one_by_one.select(cols).collect()))
    stored = tables.write_bucketed(df, "sides_bucketed", str(tmp_path / "b"), keys=["store_nbr", "family"], sort=["date"], buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = X.build_feature_matrix(stored, groups=groups, extras=extras)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The panel with its lags is moved once, by store and day; nothing is hashed on the store alone but store-days.
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(store_nbr" in line and "date" in line.split("hashpartitioning")[1]]
    assert 1 <= len(moved) <= 3
    spark.sql("DROP TABLE sides_bucketed")


def test_days_within_a_range_equal_a_filter_on_all_days(spark):
    from tidepanel.operators.clean import densify

    rows = [(1, "A", day(3), 2.0), (1, "A", day(9), 5.0), (2, "A", day(0), 1.0), (3, "B", day(30), 4.0), (4, "B", day(6), 0.5), (4, "B", day(7), 7.0)]
    sparse = spark.createDataFrame(rows, "store_nbr int, family string, date date, sales double")
    args = dict(entity_cols=["store_nbr", "family"], date_col="date", start=str(day(0)), end=str(day(30)), fill={"sales": 0.0})
    every = densify(sparse, **args)
    for low, high in ((5, 8), (0, 3), (20, None), (None, 6), (30, 30), (None, None)):
        ends = tuple(None if n is None else str(day(n)) for n in (low, high))
        kept = every.where(F.col("date").between(day(low or 0), day(30 if high is None else high)))
        got = densify(sparse, **args, within=ends)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept.collect()))
        assert got.select("store_nbr").distinct().count() == 4


def test_integrity_and_coverage_hold_no_group_per_day(spark):
    from tidepanel.operators import explore

    days = [day(0), day(0), day(1), day(63), day(64), day(200), dt.date(1969, 12, 31), dt.date(1960, 1, 1), None, None]
    df = spark.createDataFrame([(1, "A", d, 1.0) for d in days] + [(None, "A", day(5), 0.0), (2, "A", day(0), -1.0)],
                               "store_nbr int, family string, date date, sales double")
    row = explore.panel_integrity(df).first()
    assert (row["n_rows"], row["n_duplicate_keys"], row["n_negative"]) == (12, 2, 1)
    tx = df.where("date in (date'2017-01-01', date'1969-12-31') or date is null").select("date", "store_nbr")
    cover = explore.transaction_coverage(df, tx).first()
    # Ten store-days in all, one of them without a date, one without a store; three have a record.
    assert cover["n_store_days"] == 10 and cover["coverage"] == pytest.approx(0.3)
    for made in (explore.panel_integrity(df), explore.transaction_coverage(df, tx)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "bit_or" in plan and not re.search(r"keys=\[[^\]]*\bdate#", plan)


def test_copies_are_dropped_where_they_lie(spark):
    from tidepanel.operators.clean import keep_one

    rows = spark.createDataFrame([(1, 2.0), (1, None), (1, 5.0), (2, None)], "k int, v double")
    kept = keep_one(rows, ["k"])
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, 5.0), (2, None)]
    assert keep_one(rows, ["k"], keep="first").where("k = 1").first()["v"] is None
    assert "SortAggregate" not in kept._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_rows_of_the_filled_panel(spark, monkeypatch):
    from tidepanel.session import drop_saved
    from tidepanel.sources import warehouse

    drop_saved(spark)
    monkeypatch.setattr(warehouse, "ROWS_PER_BUCKET", 10_000)
    w = warehouse.Warehouse(spark, "/root/testdata/sf0.001")
    rows, parts = w.panel().count(), w.panel().rdd.getNumPartitions()
    drop_saved(spark)
    assert parts >= rows / 10_000 > 4


def test_whole_numbers_are_not_rounded_by_decimals(spark):
    from tidepanel.catalog.registry import tidy

    values = [0.0, -0.0, 7.0, -3.0, 1e300, 0.1234567, -2.0000005, 2.5, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [str(r["v"]) for r in tidy(df).orderBy("i").collect()]
    want = [str(r["v"]) for r in df.orderBy("i").select((F.round("v", 6) + F.lit(0.0)).alias("v")).collect()]
    assert got == want and "rint" in tidy(df)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_interim_rows_that_lie_by_store_are_not_moved(spark, tmp_path):
    from tidepanel.sources.tables import write_interim

    df = spark.createDataFrame([(s, "A", day(d)) for d in range(5) for s in range(20)], "store_nbr int, family string, date date")
    write_interim({"train": df.repartition(4, "store_nbr")}, str(tmp_path), {"train": ("store_nbr", "family", "date")}, placed=["train"])
    back = spark.read.parquet(f"{tmp_path}/train.parquet").withColumn("_file", F.input_file_name())
    files = back.groupBy("store_nbr").agg(F.count_distinct("_file").alias("n"), F.count("*").alias("rows"))
    assert {(r["n"], r["rows"]) for r in files.collect()} == {(1, 5)} and back.select("_file").distinct().count() > 1
    one = back.select("_file").first()["_file"]
    keys = [tuple(r) for r in spark.read.parquet(one).select("store_nbr", "date").collect()]
    assert keys == sorted(keys)
