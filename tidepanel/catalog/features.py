"""Queries over projections, masks, joins, windows and the feature matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.catalog.registry import EVENT, TRAIN_END, oracle, query
from tidepanel.catalog.sources import CLEAN_OIL, METHODS, folds_of, oof, oof_wide, sliced_oof
from tidepanel.functions import scalars as S
from tidepanel.functions.metrics import rmsle
from tidepanel.operators import explore
from tidepanel.operators import features as X
from tidepanel.operators.blend import align_oofs, ensemble_mean
from tidepanel.operators.clean import (
    assert_nonnegative, clean_holidays, clean_oil, clean_train, flag_invalid_sales, keep_one,
)
from tidepanel.operators.contracts import (
    align_submission, duplicate_keys, only_in, order_mismatches, submission_checks,
)
from tidepanel.operators.evaluation import annotate_horizon, annotate_payday, annotate_zero_target
from tidepanel.operators.masks import (
    fill_from_oof, mask_numeric_after, mask_target_after, mask_with_label, write_back,
)
from tidepanel.operators.naive import last_value_predict, naive_oof, seasonal_lookup, seasonal_naive_predict, to_long
from tidepanel.operators.panel import fold_matrices, prune_panel, train_test_panel, training_matrix
from tidepanel.operators.splits import (
    date_grid, expand_folds, expanding_folds, fold_ranges, folds_frame, holdout_flags, inner_folds, leakage_report,
)
from tidepanel.session import saved, scratch_path
from tidepanel.sources.runs import write_submission
from tidepanel.sources.tables import INPUT_ORDER, with_input_order

KEY = "store_nbr, family, date"
KEYS = ["store_nbr", "family", "date"]
LONG = {"origin": "2001-06-30"}

# --- projections and masks ---------------------------------------------------


@query("b1_prune_panel", oracle(f"SELECT {KEY}, sales, onpromotion FROM train", "sales"))
def _(w):
    return prune_panel(w.train())


@query("b2_base_features", oracle(f"SELECT {KEY}, CAST(0 AS INT) AS onpromotion FROM train"))
def _(w):
    return X.add_base_features(w.train().select(*KEYS))


CALENDAR = (
    "CAST(isodow(date) - 1 AS INT) AS {dow}, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS {dom}, "
    "CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(day(date) = 15 OR date = last_day(date) AS INT) AS is_payday, "
    f"CAST(date >= DATE '{EVENT}' AS INT) AS post_eq"
)
SINCE = f"CAST(date_diff('day', DATE '{EVENT}', date) AS INT)"


@query("b3_calendar_features", oracle(
    f"SELECT {KEY}, {CALENDAR.format(dow='dayofweek', dom='day')}, {SINCE} AS days_since_eq FROM panel"))
def _(w):
    return X.add_calendar_features(w.panel().select(*KEYS), event_date=EVENT)


@query("b3b_calendar_compact", oracle(
    f"SELECT {KEY}, {CALENDAR.format(dow='dow', dom='dom')}, CAST(weekofyear(date) AS INT) AS weekofyear, "
    f"GREATEST({SINCE}, 0) AS days_since_eq FROM panel"))
def _(w):
    return X.add_calendar_features_compact(w.panel().select(*KEYS), event_date=EVENT)


@query("b4_promo_features", oracle(
    f"SELECT {KEY}, onpromotion, LN(1 + GREATEST(onpromotion, 0)) AS onpromotion_log1p, "
    "CAST(onpromotion > 0 AS INT) AS has_promotion FROM panel", "onpromotion_log1p"))
def _(w):
    return X.add_promo_features(w.panel().select(*KEYS, "onpromotion"))


@query("b5_invalid_flag", oracle(
    "SELECT c_custkey, c_acctbal AS sales, COALESCE(c_acctbal < 0, FALSE) AS is_invalid FROM customer", "sales"))
def _(w):
    return flag_invalid_sales(w.table("customer").select("c_custkey", F.col("c_acctbal").alias("sales")))


@query("b6_negative_guard", oracle("SELECT COUNT(*) AS n_rows, SUM(sales) AS total FROM train", "total"))
def _(w):
    return assert_nonnegative(w.train()).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("total"))


@query("b7_origin_mask", oracle(
    "SELECT t.store_nbr, t.family, f.fold, COUNT(*) AS n_rows, CAST(COUNT(CASE WHEN t.date > f.train_end THEN 1 END) AS BIGINT) AS n_masked, "
    "SUM(CASE WHEN t.date <= f.train_end THEN t.sales END) AS kept_sales FROM train t JOIN folds f ON t.date <= f.val_end GROUP BY 1, 2, 3", "kept_sales"))
def _(w):
    rows = expand_folds(w.train().select(*KEYS, "sales"), folds_of(w))
    masked = mask_target_after(rows, F.col("train_end"))
    return masked.groupBy("store_nbr", "family", "fold").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("sales").isNull()).alias("n_masked"), F.sum("sales").alias("kept_sales"))


@query("b8_outcome_mask", oracle(
    f"SELECT date, store_nbr, CASE WHEN date <= DATE '{LONG['origin']}' THEN transactions END AS transactions FROM tx"))
def _(w):
    return mask_numeric_after(w.transactions(), LONG["origin"])


@query("b9_fold_rows", oracle(
    "SELECT f.fold, CASE WHEN t.date <= f.train_end THEN 'train' ELSE 'val' END AS role, COUNT(*) AS n, SUM(t.sales) AS total "
    "FROM train t JOIN folds f ON t.date <= f.val_end GROUP BY 1, 2", "total"))
def _(w):
    return expand_folds(w.train(), folds_of(w)).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales").alias("total"))


@query("b11_finite_target", oracle(
    f"SELECT {KEY}, y FROM (SELECT {KEY}, CASE WHEN onpromotion > 0 THEN sales / onpromotion END AS y FROM train) WHERE y IS NOT NULL", "y"))
def _(w):
    # Division by zero promotions gives infinity, a zero over zero NaN: both must go.
    y = F.when(F.col("onpromotion") > 0, F.col("sales") / F.col("onpromotion")).when(
        F.col("sales") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return w.train().select(*KEYS, y.alias("y")).where(S.is_finite("y"))


@query("b12_horizon", oracle(
    "SELECT store_nbr, family, date, fold, horizon FROM sliced"))
def _(w):
    folds = folds_of(w)
    return annotate_horizon(oof(w, folds), folds).select(*KEYS, "fold", "horizon")


@query("b13_payday", oracle("SELECT store_nbr, family, date, fold, is_payday FROM sliced"))
def _(w):
    return annotate_payday(oof(w)).select(*KEYS, "fold", "is_payday")


@query("b14_zero_target", oracle("SELECT store_nbr, family, date, fold, is_zero FROM sliced"))
def _(w):
    return annotate_zero_target(oof(w)).select(*KEYS, "fold", "is_zero")


@query("b15_lookback_slice", oracle(
    f"SELECT {KEY}, sales FROM train WHERE date BETWEEN DATE '{LONG['origin']}' - 56 AND DATE '{LONG['origin']}'", "sales"))
def _(w):
    day = F.lit(LONG["origin"]).cast("date")
    return w.train().select(*KEYS, "sales").where(F.col("date").between(F.date_sub(day, 56), day))


CODES = ("SELECT t.store_nbr, t.family, t.date, {code} FROM train t LEFT JOIN (SELECT family, CAST(row_number() OVER (ORDER BY family) - 1 AS INT) AS c "
         "FROM (SELECT DISTINCT family FROM train WHERE family <> 'PROMO')) l ON l.family = t.family")


@query("b16_category_codes", oracle(CODES.format(code="l.c AS family_code")))
def _(w):
    seen = w.train().where("family <> 'PROMO'")
    return X.encode_levels(w.train().select(*KEYS), seen, ["family"])


@query("b17_category_codes_unseen", oracle(CODES.format(code="COALESCE(l.c, -1) AS family_code")))
def _(w):
    seen = w.train().where("family <> 'PROMO'")
    return X.encode_levels(w.train().select(*KEYS), seen, ["family"], unseen=-1)


@query("b18_numeric_features", oracle(f"SELECT {KEY}, onpromotion, LN(1 + onpromotion) AS onpromotion_log1p, CAST(onpromotion > 0 AS INT) AS has_promotion FROM train", "onpromotion_log1p"))
def _(w):
    made = X.add_promo_features(w.train())
    cols = X.numeric_feature_columns(made, exclude=("date", "sales", "store_nbr"))
    return made.select(*KEYS, *cols)


@query("b19_nonnegative_clip", oracle("SELECT c_custkey, GREATEST(c_acctbal, 0.0) AS y_pred FROM customer", "y_pred"))
def _(w):
    return w.table("customer").select("c_custkey", S.nonnegative("c_acctbal").alias("y_pred"))


@query("b20_recent_slice", oracle(
    f"SELECT {KEY}, sales FROM train WHERE date >= (SELECT MAX(date) FROM train) - 180 AND store_nbr IN (SELECT store_nbr FROM stores WHERE type = 'A')", "sales"))
def _(w):
    chosen = w.stores().where("type = 'A'").select("store_nbr")
    return explore.recent_slice(w.train().select(*KEYS, "sales"), chosen, 180, ["store_nbr"])


@query("b21_leakage_audit", oracle(
    f"SELECT {KEY}, sales_lag_1 AS unsafe_lag_1, CASE WHEN prev <= DATE '{LONG['origin']}' THEN sales_lag_1 END AS masked_lag_1, "
    f"prev > DATE '{LONG['origin']}' AS leaks FROM (SELECT *, LAG(sales) OVER w AS sales_lag_1, LAG(date) OVER w AS prev FROM train "
    "WINDOW w AS (PARTITION BY store_nbr, family ORDER BY date)) "
    f"WHERE date IN (DATE '{LONG['origin']}' + 1, DATE '{LONG['origin']}' + 2)", "unsafe_lag_1 masked_lag_1"))
def _(w):
    # Both versions of the lag sit side by side in one window, so no join is needed.
    both = mask_with_label(w.train(), LONG["origin"])
    unsafe = X.add_lag_features(both, target_col="y_true", lags=(1,))
    made = X.add_lag_features(unsafe, lags=(1,))
    origin = F.lit(LONG["origin"]).cast("date")
    return made.where(F.datediff("date", origin).isin(1, 2)).select(
        *KEYS, F.col("y_true_lag_1").alias("unsafe_lag_1"), F.col("sales_lag_1").alias("masked_lag_1"),
        (F.col("y_true_lag_1").isNotNull() & F.col("sales_lag_1").isNull()).alias("leaks"))


# --- joins -------------------------------------------------------------------
OIL_LAG = "SELECT date, LAG(dcoilwtico) OVER (ORDER BY date) AS oil_lag_1 FROM filled"


@query("c1_oil_join", oracle(f"SELECT p.store_nbr, p.family, p.date, oil_lag_1 FROM panel p LEFT JOIN oillag o ON o.date = p.date",
                             "oil_lag_1", filled=CLEAN_OIL, oillag=OIL_LAG))
def _(w):
    return X.add_oil_features(w.panel().select(*KEYS), w.oil())


HOLIDAY = """SELECT p.store_nbr, p.family, p.date,
 CAST(p.date IN (SELECT date FROM kept WHERE locale = 'National') AS INT) AS is_national_holiday,
 CAST((p.date, s.state) IN (SELECT (date, locale_name) FROM kept WHERE locale = 'Regional') AS INT) AS is_regional_holiday,
 CAST((p.date, s.city) IN (SELECT (date, locale_name) FROM kept WHERE locale = 'Local') AS INT) AS is_local_holiday,
 CAST(p.date IN (SELECT date FROM kept WHERE type = 'Bridge') AS INT) AS is_bridge,
 CAST(p.date IN (SELECT date FROM kept WHERE type = 'Work Day') AS INT) AS is_work_day,
 CAST(p.date IN (SELECT date FROM kept WHERE type = 'Transfer') AS INT) AS is_transfer
 FROM panel p LEFT JOIN stores s USING (store_nbr)"""
KEPT = "SELECT * FROM hol WHERE NOT transferred"
FLAGS = ["is_national_holiday", "is_regional_holiday", "is_local_holiday", "is_bridge", "is_work_day", "is_transfer"]


@query("c2_holiday_flags", oracle(
    "SELECT *, GREATEST(is_national_holiday, is_regional_holiday, is_local_holiday) AS is_holiday FROM hflags",
    kept=KEPT, hflags=HOLIDAY))
def _(w):
    made = X.add_holiday_features(w.panel().select(*KEYS), w.holidays_events(), w.stores())
    return made.select(*KEYS, *FLAGS, "is_holiday")


@query("c2_holiday_flags_without_stores", oracle(
    "SELECT store_nbr, family, date, is_national_holiday, CAST(0 AS INT) AS is_regional_holiday, CAST(0 AS INT) AS is_local_holiday, "
    "is_national_holiday AS is_holiday FROM hflags", kept=KEPT, hflags=HOLIDAY))
def _(w):
    made = X.add_holiday_features(w.panel().select(*KEYS), w.holidays_events())
    return made.select(*KEYS, *FLAGS[:3], "is_holiday")


for _name, _flag in (("c2a_national", FLAGS[0]), ("c2b_regional", FLAGS[1]), ("c2c_local", FLAGS[2])):

    @query(f"{_name}_membership", oracle(
        f"SELECT store_nbr, date, SUM({_flag})::BIGINT AS n FROM hflags GROUP BY 1, 2 HAVING SUM({_flag}) > 0", kept=KEPT, hflags=HOLIDAY))
    def _(w, flag=_flag):
        made = X.add_holiday_features(w.panel().select(*KEYS), w.holidays_events(), w.stores())
        # Days without the flag add nothing: they go before the groups are built, not after.
        return made.where(F.col(flag) > 0).groupBy("store_nbr", "date").agg(F.sum(flag).alias("n"))


@query("c3_store_geography", oracle(f"SELECT p.store_nbr, family, date, city, state FROM panel p LEFT JOIN stores USING (store_nbr)"))
def _(w):
    return w.panel().select(*KEYS).join(X.store_geography(w.stores()), "store_nbr", "left")


@query("c4_store_meta", oracle(
    "SELECT p.store_nbr, family, date, city, state, type AS store_type, cluster FROM panel p LEFT JOIN stores USING (store_nbr)"))
def _(w):
    return X.add_store_meta_features(w.panel().select(*KEYS, F.lit("old").alias("city")), w.stores())


TXF = ("SELECT date, store_nbr, LAG(transactions) OVER w AS transactions_lag_1, AVG(transactions) OVER (PARTITION BY store_nbr ORDER BY date "
       "ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS transactions_roll_mean_7 FROM tx WINDOW w AS (PARTITION BY store_nbr ORDER BY date)")


@query("c5_transaction_join", oracle(
    "SELECT p.store_nbr, p.family, p.date, transactions_lag_1, transactions_roll_mean_7 FROM panel p "
    "LEFT JOIN txf t ON t.store_nbr = p.store_nbr AND t.date = p.date", "transactions_roll_mean_7", txf=TXF))
def _(w):
    return X.add_transaction_features(w.panel().select(*KEYS), w.transactions())


@query("c6_label_kept_beside_mask", oracle(
    f"SELECT {KEY}, sales AS y_true, CASE WHEN date <= DATE '{LONG['origin']}' THEN sales END AS sales FROM train", "sales y_true"))
def _(w):
    return mask_with_label(w.train(), LONG["origin"]).select(*KEYS, "y_true", "sales")


@query("c7_write_back", oracle(
    "SELECT t.store_nbr, t.family, t.date, COALESCE(o.y_pred, t.sales) AS sales FROM train t LEFT JOIN oof o "
    "ON o.store_nbr = t.store_nbr AND o.family = t.family AND o.date = t.date", "sales"))
def _(w):
    return write_back(w.train().select(*KEYS, "sales"), oof(w))


@query("c8_fill_from_oof", oracle(
    "SELECT f.fold, t.store_nbr, t.family, t.date, CASE WHEN t.date <= f.train_end THEN t.sales ELSE o.y_pred END AS sales FROM train t "
    "JOIN folds f ON t.date <= f.val_end LEFT JOIN oof o ON o.fold = f.fold AND o.store_nbr = t.store_nbr "
    "AND o.family = t.family AND o.date = t.date", "sales"))
def _(w):
    """Every row of the filled panel of every fold."""
    folds = folds_of(w)
    made = saved(oof(w, folds), "oof")
    parts = []
    for f in folds:
        inside = w.train().select(*KEYS, "sales").where(F.col("date") <= F.lit(f.val_end))
        filled = fill_from_oof(inside, made.where(F.col("fold") == f.fold), f.train_end)
        parts.append(filled.select(F.lit(f.fold).alias("fold"), *KEYS, "sales"))
    return reduce(DataFrame.unionByName, parts)


TEST_PRED = "SELECT id, store_nbr, family, date, CAST(onpromotion AS DOUBLE) * 2 AS sales FROM test"


@query("c9_align_submission", oracle("SELECT id, sales FROM tp", "sales", tp=TEST_PRED))
def _(w):
    preds = w.test().select("id", (F.col("onpromotion") * 2.0).alias("sales"))
    return align_submission(preds, w.sample_submission())


@query("c10_align_oofs", oracle("SELECT * FROM oofw", "y_true last_value seasonal_naive_7 seasonal_naive_14"))
def _(w):
    wide = oof_wide(w)
    runs = {m: wide.withColumnRenamed(m, "y_pred") for m in METHODS}
    return align_oofs(runs)


@query("c11_segment_attributes", oracle("SELECT * FROM sliced", "y_true y_pred"))
def _(w):
    return sliced_oof(w)


@query("c12_id_recovery", oracle("SELECT id, store_nbr, family, date FROM test"))
def _(w):
    # Ids ride along with the panel rows and come back by key only to be checked.
    rows = w.test()
    keyed = rows.select(*KEYS).join(rows.select(*KEYS, "id").hint("shuffle_hash"), KEYS, "left")
    return keyed.select(
        F.coalesce("id", F.raise_error(F.lit("a forecast row has no id")).cast("bigint")).alias("id"), *KEYS)


SNT = """SELECT t.store_nbr, t.family, t.date, COALESCE(h.sales{last}, 0.0) AS y_pred FROM test t
 LEFT JOIN sparse_train h ON h.store_nbr = t.store_nbr AND h.family = t.family
 AND h.date = t.date - 7 * GREATEST(1, CAST(CEIL((t.date - {end}) / 7.0) AS INT))
 LEFT JOIN (SELECT store_nbr, family, arg_max(sales, date) AS lv FROM sparse_train GROUP BY 1, 2) l
 ON l.store_nbr = t.store_nbr AND l.family = t.family"""
SPARSE_TRAIN = f"SELECT * FROM sparse WHERE date <= {TRAIN_END}"


@query("c13_seasonal_lookup", oracle(
    "SELECT t.store_nbr, t.family, t.date, h.sales AS seasonal FROM train t LEFT JOIN train h ON h.store_nbr = t.store_nbr "
    "AND h.family = t.family AND h.date = t.date - 7", "seasonal"))
def _(w):
    """The value a week earlier of every panel row."""
    return seasonal_lookup(w.train().select(*KEYS, "sales"), 7).select(*KEYS, "seasonal")


@query("c14_last_value_map", oracle(
    "SELECT s.store_nbr, s.family, l.lv AS last_sales FROM (SELECT DISTINCT store_nbr, family FROM test) s LEFT JOIN "
    "(SELECT store_nbr, family, arg_max(sales, date) AS lv FROM sparse_train GROUP BY 1, 2) l USING (store_nbr, family)",
    "last_sales", sparse_train=SPARSE_TRAIN))
def _(w):
    seen = w.panel_sparse().where(F.col("date") <= F.lit(w.train_end).cast("date"))
    last = seen.groupBy("store_nbr", "family").agg(F.max_by("sales", "date").alias("last_sales"))
    return w.test().select("store_nbr", "family").distinct().join(last, ["store_nbr", "family"], "left")


@query("c15_transaction_coverage", oracle(
    "SELECT COUNT(*) AS n_store_days, AVG(CASE WHEN t.store_nbr IS NULL THEN 0 ELSE 1 END) AS coverage "
    "FROM (SELECT DISTINCT date, store_nbr FROM train) d LEFT JOIN tx t ON t.date = d.date AND t.store_nbr = d.store_nbr", "coverage"))
def _(w):
    return explore.transaction_coverage(w.train(), w.transactions())


@query("c16_entity_restriction", oracle(
    f"SELECT {KEY}, sales FROM train WHERE (store_nbr, family) IN (SELECT (store_nbr, family) FROM train GROUP BY store_nbr, family HAVING SUM(sales) > 300)", "sales"))
def _(w):
    rows = w.train().select(*KEYS, "sales")
    big = rows.groupBy("store_nbr", "family").agg(F.sum("sales").alias("s")).where("s > 300")
    return rows.join(big, ["store_nbr", "family"], "left_semi")


@query("c17_above_entity_p99", oracle(
    "SELECT CAST(SUM(CASE WHEN sales > p THEN 1 ELSE 0 END) AS BIGINT) AS n_above, AVG(CASE WHEN sales > p THEN 1 ELSE 0 END) AS share_above "
    "FROM (SELECT sales, quantile_cont(sales, 0.99) OVER (PARTITION BY store_nbr, family) AS p FROM train)", "share_above"))
def _(w):
    return explore.spikes_above_p99(w.train())


@query("c18_columns_per_seed", oracle(
    "SELECT store_nbr, family, date, fold, last_value, seasonal_naive_7, seasonal_naive_14, (last_value + seasonal_naive_7 + seasonal_naive_14) / 3 AS y_mean FROM oofw",
    "last_value seasonal_naive_7 seasonal_naive_14 y_mean"))
def _(w):
    long = to_long(oof_wide(w), METHODS)
    return long.groupBy(*KEYS, "fold").agg(
        *[F.max(F.when(F.col("method") == m, F.col("y_pred"))).alias(m) for m in METHODS], F.avg("y_pred").alias("y_mean"))


@query("c19_forecast_panel", oracle(
    "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT date) AS n_days, SUM(sales) AS total FROM tp", "total", tp=TEST_PRED))
def _(w):
    sub = w.test().select("id", (F.col("onpromotion") * 2.0).alias("sales"))
    return w.test().join(sub, "id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_days"), F.sum("sales").alias("total"))


@query("c20_sales_by_store_attribute", oracle(
    "SELECT 'type' AS attribute, type AS value, AVG(sales) AS mean_sales FROM train JOIN stores USING (store_nbr) GROUP BY 2 UNION ALL "
    "SELECT 'cluster', CAST(cluster AS VARCHAR), AVG(sales) FROM train JOIN stores USING (store_nbr) GROUP BY 2", "mean_sales"))
def _(w):
    return explore.sales_by_store_attribute(w.train(), w.stores())


# --- windows -----------------------------------------------------------------
@query("e1_causal_fill", oracle("SELECT * FROM filled", "dcoilwtico", filled=CLEAN_OIL))
def _(w):
    return clean_oil(w.oil())


LAGS = ", ".join(f"LAG(sales, {k}) OVER w AS sales_lag_{k}" for k in X.DEFAULT_LAGS)
ROLLS = ", ".join(
    f"{fn}(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS sales_roll_{s}_{n}"
    for n in X.DEFAULT_WINDOWS for s, fn in (("mean", "AVG"), ("std", "STDDEV_SAMP")))
OVER = "WINDOW w AS (PARTITION BY store_nbr, family ORDER BY date)"
LAG_COLS = " ".join(X.lag_names(X.DEFAULT_LAGS))
ROLL_COLS = " ".join(X.rolling_names(X.DEFAULT_WINDOWS, X.DEFAULT_STATS))


@query("e2_entity_lags", oracle(f"SELECT {KEY}, {LAGS} FROM train {OVER}", LAG_COLS))
def _(w):
    return X.add_lag_features(w.train().select(*KEYS, "sales")).drop("sales")


@query("e2_entity_lags_gappy", oracle(f"SELECT {KEY}, {LAGS} FROM sparse {OVER}", LAG_COLS))
def _(w):
    return X.add_lag_features(w.panel_sparse().select(*KEYS, "sales")).drop("sales")


@query("e3_shifted_rolling", oracle(f"SELECT {KEY}, {ROLLS} FROM train", ROLL_COLS))
def _(w):
    return X.add_rolling_features(w.train().select(*KEYS, "sales")).drop("sales")


@query("e4_oil_row_shift", oracle("SELECT * FROM oillag", "oil_lag_1", filled=CLEAN_OIL, oillag=OIL_LAG))
def _(w):
    return X.oil_features(w.oil())


@query("e5_store_transaction_windows", oracle("SELECT * FROM txf", "transactions_roll_mean_7", txf=TXF))
def _(w):
    return X.transaction_features(w.transactions())


@query("e6_keep_last", oracle(
    "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, MAX((o_orderdate, o_orderkey))[2] AS o_orderkey FROM orders GROUP BY 1",
    "o_totalprice"))
def _(w):
    rows = w.table("orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("seq"), "o_totalprice")
    return keep_one(rows, ["o_custkey"], "seq").select("o_custkey", "o_totalprice", F.col("seq.o_orderkey").alias("o_orderkey"))


@query("e6_keep_first", oracle(
    "SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, MIN((o_orderdate, o_orderkey))[2] AS o_orderkey FROM orders GROUP BY 1",
    "o_totalprice"))
def _(w):
    rows = w.table("orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("seq"), "o_totalprice")
    return keep_one(rows, ["o_custkey"], "seq", keep="first").select(
        "o_custkey", "o_totalprice", F.col("seq.o_orderkey").alias("o_orderkey"))


@query("e7_date_grid", oracle(
    "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS idx, CAST(row_number() OVER (ORDER BY date DESC) - 1 AS INT) AS from_end FROM (SELECT DISTINCT date FROM train)"))
def _(w):
    return date_grid(w.train())


@query("e8_fold_numbering", oracle("SELECT fold, val_start FROM folds"))
def _(w):
    return expanding_folds(w.train()).select("fold", "val_start")


STEPS = {"last_value": 0, "seasonal_naive_14": 1, "seasonal_naive_7": 2}
STEP_FOLDS = ("SELECT CAST(CASE method WHEN 'last_value' THEN 0 WHEN 'seasonal_naive_14' THEN 1 ELSE 2 END AS INT) AS step, fold, "
              "SQRT(AVG(POW(LN(1 + y_pred) - LN(1 + y_true), 2))) AS rmsle FROM oofl GROUP BY 1, 2")


def _step_folds(w):
    step = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    return to_long(oof_wide(w), METHODS).groupBy(step[F.col("method")].alias("step"), "fold").agg(rmsle("y_true", "y_pred").alias("rmsle"))


@query("e9_ablation_deltas", oracle(
    "SELECT step, mean_rmsle, mean_rmsle - LAG(mean_rmsle) OVER (ORDER BY step) AS delta FROM (SELECT step, AVG(rmsle) AS mean_rmsle FROM stepf GROUP BY 1)",
    "mean_rmsle delta", stepf=STEP_FOLDS))
def _(w):
    return explore.ablation_deltas(_step_folds(w).groupBy("step").agg(F.avg("rmsle").alias("mean_rmsle")))


@query("e10_ablation_stability", oracle(
    "SELECT step, CAST(SUM(CASE WHEN rmsle < b THEN 1 ELSE 0 END) AS BIGINT) AS folds_improved, SUM(CASE WHEN rmsle < b THEN 1 ELSE 0 END) >= 2 AS keep "
    "FROM (SELECT *, LAG(rmsle) OVER (PARTITION BY fold ORDER BY step) AS b FROM stepf) WHERE b IS NOT NULL GROUP BY 1", stepf=STEP_FOLDS))
def _(w):
    return explore.ablation_stability(_step_folds(w))


# --- set operations and contracts --------------------------------------------
@query("g1_train_test_panel", oracle(
    "SELECT store_nbr, family, date, sales, onpromotion FROM train UNION ALL SELECT store_nbr, family, date, NULL, onpromotion FROM test", "sales"))
def _(w):
    return train_test_panel(w.train(), w.test()).select(*KEYS, "sales", "onpromotion")


@query("g2_stacked_forecasts", oracle("SELECT store_nbr, family, date, fold, y_true, method, y_pred FROM oofl", "y_true y_pred"))
def _(w):
    return to_long(oof_wide(w), METHODS)


@query("g3_entity_turnover", oracle(
    "SELECT store_nbr, family, CASE WHEN late THEN 'only_late' ELSE 'only_early' END AS presence FROM "
    "(SELECT store_nbr, family, bool_or(date >= DATE '2001-06-01') AS late, bool_or(date < DATE '2001-06-01') AS early FROM sparse GROUP BY 1, 2) WHERE late <> early"))
def _(w):
    return explore.entity_turnover(w.panel_sparse(), "2001-06-01")


@query("g4_id_set_difference", oracle(
    "SELECT 'extra' AS side, id FROM test WHERE family = 'LARGE' AND onpromotion = 0 UNION ALL SELECT 'missing', id FROM test WHERE onpromotion > 0"))
def _(w):
    test = w.test()
    sample = test.where("not (family = 'LARGE' and onpromotion = 0)")
    sub = test.where("onpromotion = 0")
    return only_in(sub, sample, ["id"]).select(F.lit("extra").alias("side"), "id").unionByName(
        only_in(sample, sub, ["id"]).select(F.lit("missing").alias("side"), "id"))


@query("g5_duplicate_keys", oracle("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 1"))
def _(w):
    return duplicate_keys(w.table("orders"), ["o_custkey"])


INNER = ("SELECT f.fold, MAX(CASE WHEN r = 15 THEN date END) AS train_end, MAX(CASE WHEN r = 14 THEN date END) AS val_start, "
         "MAX(CASE WHEN r = 0 THEN date END) AS val_end FROM (SELECT f.fold, g.date, row_number() OVER (PARTITION BY f.fold ORDER BY g.date DESC) - 1 AS r "
         "FROM grid g JOIN folds f ON g.date <= f.train_end) f GROUP BY 1")


@query("g6_inner_inside_outer", oracle(
    "SELECT f.fold, i.val_end <= f.train_end AND i.train_end < i.val_start AS is_nested FROM folds f JOIN innerf i USING (fold)", innerf=INNER))
def _(w):
    folds = folds_of(w)
    outer = folds_frame(w.spark, folds).select("fold", F.col("train_end").alias("outer_end"))
    inner = inner_folds(w.train(), folds)
    return inner.join(F.broadcast(outer), "fold").select(
        "fold", ((F.col("val_end") <= F.col("outer_end")) & (F.col("train_end") < F.col("val_start"))).alias("is_nested"))


@query("g7_distinct_keys", oracle("SELECT DISTINCT store_nbr, family FROM train"))
def _(w):
    return w.train().select("store_nbr", "family").distinct()


SUB_BAD = "SELECT id, CASE WHEN onpromotion > 1 THEN NULL ELSE onpromotion - 1.0 END AS sales FROM test WHERE family <> 'LARGE'"


@query("p1_submission_checks", oracle(
    "SELECT (SELECT COUNT(*) FROM sb) AS n_sub, (SELECT COUNT(*) FROM test) AS n_sample, "
    "(SELECT COUNT(*) FROM sb WHERE id NOT IN (SELECT id FROM test)) AS n_extra, (SELECT COUNT(*) FROM test WHERE id NOT IN (SELECT id FROM sb)) AS n_missing, "
    "(SELECT COUNT(*) FROM sb WHERE sales IS NULL) AS n_nonfinite, (SELECT COUNT(*) FROM sb WHERE sales < 0) AS n_negative, CAST(0 AS BIGINT) AS n_duplicate_ids", sb=SUB_BAD))
def _(w):
    sub = w.test().where("family <> 'LARGE'").select(
        "id", F.when(F.col("onpromotion") > 1, F.lit(float("nan"))).otherwise(F.col("onpromotion") - 1.0).alias("sales"))
    return submission_checks(sub, w.sample_submission())


@query("p2_submission_order_and_sign", oracle(
    "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN sales IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(SUM(CASE WHEN sales < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative, "
    "CAST(0 AS BIGINT) AS n_out_of_order, CAST(COUNT(*) - COUNT(*) % 2 AS BIGINT) AS n_out_of_order_reversed FROM tp", tp=TEST_PRED))
def _(w):
    """A submission written in order and read back, and the same ids backwards as the failing case."""
    sample = saved(w.sample_submission(), "sample")
    aligned = align_submission(w.test().select("id", (F.col("onpromotion") * 2.0).alias("sales")), sample)
    path = scratch_path(w.spark, "submission")
    write_submission(aligned, path, sample)
    back = with_input_order(w.spark.read.schema("id bigint, sales double").option("header", True).csv(path))
    checks = submission_checks(back, sample)
    good = order_mismatches(back, sample.withColumn("at", F.col("id")), INPUT_ORDER, "at")
    bad = order_mismatches(back, sample.withColumn("at", -F.col("id")), INPUT_ORDER, "at")
    return checks.select(
        F.col("n_sub").alias("n"), (F.col("n_missing") + F.col("n_nonfinite")).alias("n_missing"), "n_negative",
        good.scalar().alias("n_out_of_order"), bad.scalar().alias("n_out_of_order_reversed"))


# --- splits ------------------------------------------------------------------
@query("k1_expanding_folds", oracle("SELECT * FROM folds"))
def _(w):
    return expanding_folds(w.train())


@query("k1_expanding_folds_with_gap", oracle(
    "SELECT CAST(1 - b AS INT) AS fold, (SELECT date FROM sgrid WHERE r = 30 * b + 35) AS train_end, (SELECT date FROM sgrid WHERE r = 30 * b + 29) AS val_start, "
    "(SELECT date FROM sgrid WHERE r = 30 * b) AS val_end FROM (VALUES (0), (1)) t(b)",
    sgrid="SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS r FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"))
def _(w):
    days = w.table("orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return expanding_folds(days, n_folds=2, val_days=30, gap_days=5)


RANGES = ("SELECT f.fold, MIN(CASE WHEN t.date <= f.train_end THEN t.date END) AS train_start, MAX(CASE WHEN t.date <= f.train_end THEN t.date END) AS train_max, "
          "MIN(CASE WHEN t.date >= f.val_start THEN t.date END) AS val_min, MAX(CASE WHEN t.date >= f.val_start THEN t.date END) AS val_max, "
          "CAST(SUM(CASE WHEN t.date <= f.train_end THEN 1 ELSE 0 END) AS BIGINT) AS n_train, CAST(SUM(CASE WHEN t.date >= f.val_start THEN 1 ELSE 0 END) AS BIGINT) AS n_val "
          "FROM train t JOIN folds f ON t.date <= f.val_end GROUP BY 1")


@query("k2_leakage_report", oracle(
    "SELECT fold, train_max, val_min, CAST(val_min - train_max AS INT) AS gap_observed, train_max < val_min AS is_safe FROM ranges", ranges=RANGES))
def _(w):
    return leakage_report(w.train(), folds_of(w))


@query("k3_inner_last_block", oracle("SELECT * FROM innerf", innerf=INNER))
def _(w):
    return inner_folds(w.train(), folds_of(w))


@query("k4_holdout_rows", oracle(
    f"SELECT date >= DATE '{LONG['origin']}' - 14 AS is_holdout, COUNT(*) AS n, SUM(sales) AS total FROM train WHERE date <= DATE '{LONG['origin']}' GROUP BY 1", "total"))
def _(w):
    return holdout_flags(w.train(), LONG["origin"]).groupBy("is_holdout").agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("total"))


@query("k5_fold_ranges", oracle("SELECT * FROM ranges", ranges=RANGES))
def _(w):
    return fold_ranges(w.train(), folds_of(w))


@query("k6_fold_panel", oracle(
    "SELECT f.fold, t.store_nbr, t.family, COUNT(*) AS n, SUM(CASE WHEN t.date <= f.train_end THEN t.sales ELSE 0 END) AS train_sales, "
    "SUM(CASE WHEN t.date >= f.val_start THEN t.sales ELSE 0 END) AS val_sales FROM train t JOIN folds f ON t.date <= f.val_end GROUP BY 1, 2, 3", "train_sales val_sales"))
def _(w):
    rows = expand_folds(w.train(), folds_of(w))
    return rows.groupBy("fold", "store_nbr", "family").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("role") == "train", F.col("sales")).otherwise(0.0)).alias("train_sales"),
        F.sum(F.when(F.col("role") == "val", F.col("sales")).otherwise(0.0)).alias("val_sales"))


# --- feature matrix ----------------------------------------------------------
def _matrix_sql(source: str, tx: str = "txf") -> str:
    return (f"SELECT p.store_nbr, p.family, p.date, p.onpromotion, {CALENDAR.format(dow='dayofweek', dom='day').replace('date', 'p.date')}, "
            f"{SINCE.replace(', date)', ', p.date)')} AS days_since_eq, LN(1 + p.onpromotion) AS onpromotion_log1p, CAST(p.onpromotion > 0 AS INT) AS has_promotion, "
            f"{', '.join('p.' + c for c in (LAG_COLS + ' ' + ROLL_COLS).split())}, oil_lag_1, "
            f"{', '.join('h.' + c for c in FLAGS)}, GREATEST(h.is_national_holiday, h.is_regional_holiday, h.is_local_holiday) AS is_holiday, "
            f"s.city, s.state, s.type AS store_type, s.cluster, transactions_lag_1, transactions_roll_mean_7 FROM {source} p "
            "LEFT JOIN oillag o ON o.date = p.date LEFT JOIN hflags h ON h.store_nbr = p.store_nbr AND h.family = p.family AND h.date = p.date "
            f"LEFT JOIN stores s ON s.store_nbr = p.store_nbr LEFT JOIN {tx} t ON t.store_nbr = p.store_nbr AND t.date = p.date")


MATRIX_CTES = {"filled": CLEAN_OIL, "oillag": OIL_LAG, "kept": KEPT, "hflags": HOLIDAY, "txf": TXF}
MATRIX_DOUBLES = f"onpromotion_log1p {LAG_COLS} {ROLL_COLS} oil_lag_1 transactions_roll_mean_7"
ALL_GROUPS = (*X.CORE_GROUPS, *X.OPTIONAL_GROUPS)


@query("m1_feature_matrix", oracle(_matrix_sql("lagged"), MATRIX_DOUBLES, **MATRIX_CTES,
                                   lagged=f"SELECT *, {LAGS}, {ROLLS} FROM train {OVER}"))
def _(w):
    made = X.build_feature_matrix(w.train(), groups=ALL_GROUPS, extras=w.extras(), event_date=EVENT)
    return made.select(*KEYS, *[c for c in X.feature_columns(ALL_GROUPS) if c not in KEYS])


@query("m4_matrix_column_subset", oracle(f"SELECT {KEY}, sales AS y_true, {LAGS} FROM train {OVER}", "y_true " + LAG_COLS))
def _(w):
    full = training_matrix(w.train(), groups=ALL_GROUPS, extras=w.extras(), event_date=EVENT)
    return full.select(*KEYS, "y_true", *X.feature_columns(["lag"]))


FOLD_MASKED = ("SELECT fold, store_nbr, family, date, onpromotion, y_true, role, {lags}, {rolls} FROM "
               "(SELECT f.fold, t.store_nbr, t.family, t.date, t.onpromotion, t.sales AS y_true, CASE WHEN t.date <= f.train_end THEN t.sales END AS sales, "
               "CASE WHEN t.date <= f.train_end THEN 'train' ELSE 'val' END AS role FROM train t JOIN folds f ON t.date <= f.val_end) {over}").format(
                   lags=LAGS, rolls=ROLLS, over=OVER).replace("PARTITION BY store_nbr, family", "PARTITION BY fold, store_nbr, family")
TX_MASKED = ("SELECT fold, date, store_nbr, LAG(m) OVER w AS transactions_lag_1, AVG(m) OVER (PARTITION BY fold, store_nbr ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) "
             "AS transactions_roll_mean_7 FROM (SELECT f.fold, tx.*, CASE WHEN tx.date <= f.train_end THEN transactions END AS m FROM tx, folds f) "
             "WINDOW w AS (PARTITION BY fold, store_nbr ORDER BY date)")
FOLD_ROWS = _matrix_sql("masked", "txm").replace("SELECT p.store_nbr,", "SELECT p.y_true, p.role, p.fold, p.store_nbr,", 1) + " AND t.fold = p.fold"


@query("l5_fold_matrix", oracle(
    FOLD_ROWS, "y_true " + MATRIX_DOUBLES, **{k: v for k, v in MATRIX_CTES.items() if k != "txf"}, masked=FOLD_MASKED, txm=TX_MASKED))
def _(w):
    """Every row of the leak-free matrix of every fold."""
    return fold_matrices(w.train(), folds_of(w), groups=ALL_GROUPS, extras=w.extras(), event_date=EVENT)


# --- naive forecasts ---------------------------------------------------------
@query("l1_last_value", oracle(
    "SELECT t.store_nbr, t.family, t.date, COALESCE(l.lv, 0.0) AS y_pred FROM test t LEFT JOIN (SELECT store_nbr, family, arg_max(sales, date) AS lv "
    "FROM sparse_train GROUP BY 1, 2) l USING (store_nbr, family)", "y_pred", sparse_train=SPARSE_TRAIN))
def _(w):
    seen = w.panel_sparse().where(F.col("date") <= F.lit(w.train_end).cast("date"))
    return last_value_predict(seen, w.test().select(*KEYS))


@query("l2_seasonal_naive", oracle(SNT.format(last=", l.lv", end=TRAIN_END), "y_pred", sparse_train=SPARSE_TRAIN))
def _(w):
    seen = w.panel_sparse().where(F.col("date") <= F.lit(w.train_end).cast("date"))
    return seasonal_naive_predict(seen, w.test().select(*KEYS), period=7, train_end=w.train_end)


@query("l2b_seasonal_naive_no_fallback", oracle(SNT.format(last="", end=TRAIN_END), "y_pred", sparse_train=SPARSE_TRAIN))
def _(w):
    seen = w.panel_sparse().where(F.col("date") <= F.lit(w.train_end).cast("date"))
    return seasonal_naive_predict(seen, w.test().select(*KEYS), period=7, train_end=w.train_end, fallback=False)


@query("l2_seasonal_naive_all_folds", oracle("SELECT * FROM oofw", "y_true last_value seasonal_naive_7 seasonal_naive_14"))
def _(w):
    return naive_oof(w.train(), folds_of(w), periods=(7, 14))


@query("l9_ensemble_mean", oracle(
    "SELECT store_nbr, family, date, fold, AVG(y_pred) AS y_pred FROM oofl GROUP BY 1, 2, 3, 4", "y_pred"))
def _(w):
    wide = oof_wide(w)
    return ensemble_mean([wide.withColumnRenamed(m, "y_pred") for m in METHODS], [*KEYS, "fold"])


@query("o2_clean_train", oracle(
    f"SELECT {KEY}, MAX(sales) AS sales FROM train GROUP BY ALL", "sales"))
def _(w):
    # Every row twice; copies made in place leave the rows where they lie, a union would not.
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")
    return clean_train(w.train().select(*KEYS, "sales", twice).drop("_copy"))


@query("o3_clean_holidays", oracle("SELECT date, type, locale, transferred FROM hol"))
def _(w):
    return clean_holidays(w.holidays_events()).select("date", "type", "locale", "transferred")
