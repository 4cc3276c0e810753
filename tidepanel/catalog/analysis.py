"""Queries over metrics, exploration tables, forecasts, blends, search and stress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.catalog.features import FOLD_MASKED, INNER, KEY, KEYS
from tidepanel.catalog.registry import CTES, D2, EVENT, SCORE_COLS, SCORES, TRAIN_END, oracle, query
from tidepanel.catalog.sources import METHODS, folds_of, oof, oof_wide, sliced_oof
from tidepanel.functions import scalars as S
from tidepanel.functions.metrics import bias_log1p, mae_log1p, rmsle, rmsle_clipped
from tidepanel.functions.quantiles import exact_quantiles
from tidepanel.operators import explore, stress
from tidepanel.operators import features as X
from tidepanel.operators.blend import align_oofs, blend_report, gram, mean_blend, nonneg_weights, weighted_blend
from tidepanel.operators.evaluation import (
    fold_metrics, gate_vs_naive, horizon_metrics, scoreboard, seed_summary, segment_metrics, segment_table,
    summarize_folds,
)
from tidepanel.operators.naive import naive_oof, to_long
from tidepanel.operators.panel import fold_matrix, train_test_panel
from tidepanel.operators.recursive import HISTORY, forecast_column, history_for, linear_model, origin_state
from tidepanel.operators.search import best_trial, sample_trials, score_column_trials
from tidepanel.operators.splits import collect_folds, expand_folds, inner_folds
from tidepanel.plans.evaluate import evaluate
from tidepanel.plans.predict import submit, test_fold
from tidepanel.plans.train import NAIVE_RUNS, baseline_metrics, run_experiment, run_matrix
from tidepanel.session import saved, scratch_path

# --- metrics -----------------------------------------------------------------
for _name, _agg, _sql in (
    ("d1_rmsle", rmsle, f"SQRT(AVG({D2}))"),
    ("d2_mae_log1p", mae_log1p, "AVG(ABS(LN(1 + y_pred) - LN(1 + y_true)))"),
    ("d3_bias_log1p", bias_log1p, "AVG(LN(1 + y_pred) - LN(1 + y_true))"),
):

    @query(_name, oracle(f"SELECT method, {_sql} AS score FROM oofl GROUP BY 1", "score"))
    def _(w, agg=_agg):
        return to_long(oof_wide(w), METHODS).groupBy("method").agg(agg("y_true", "y_pred").alias("score"))


@query("d1b_rmsle_clipped", oracle(
    "SELECT SQRT(AVG(POW(LN(1 + GREATEST(y_pred - 20, 0)) - LN(1 + GREATEST(y_true, 0)), 2))) AS score FROM oof", "score"))
def _(w):
    return oof(w).agg(rmsle_clipped("y_true", F.col("y_pred") - 20).alias("score"))


PER_FOLD = f"SELECT fold, {SCORES} FROM oof GROUP BY 1"
FOLD_AND_ALL = f"SELECT fold, {SCORES} FROM oof GROUP BY GROUPING SETS ((fold), ())"
SUMMARY = ("SELECT AVG(rmsle) AS mean_rmsle, STDDEV_SAMP(rmsle) AS std_rmsle, AVG(mae_log1p) AS mean_mae_log1p, AVG(bias_log1p) AS mean_bias_log1p, "
           "(SELECT rmsle FROM pooled) AS pooled_oof_rmsle, (SELECT mae_log1p FROM pooled) AS pooled_oof_mae_log1p, "
           "(SELECT bias_log1p FROM pooled) AS pooled_oof_bias_log1p, (SELECT n FROM pooled) AS n_oof, COUNT(*) AS n_folds FROM perfold")
SUMMARY_D = "mean_rmsle std_rmsle mean_mae_log1p mean_bias_log1p pooled_oof_rmsle pooled_oof_mae_log1p pooled_oof_bias_log1p"
SUM_CTES = {"pooled": f"SELECT {SCORES} FROM oof", "perfold": PER_FOLD}


@query("d4_fold_metrics", oracle(FOLD_AND_ALL, SCORE_COLS))
def _(w):
    return fold_metrics(oof(w))


@query("d4_fold_summary", oracle(SUMMARY, SUMMARY_D, **SUM_CTES))
def _(w):
    return summarize_folds(fold_metrics(oof(w)))


HORIZON = f"SELECT horizon, {SCORES} FROM sliced GROUP BY 1"
SEGMENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS segment_type, CAST({c} AS VARCHAR) AS segment, {SCORES} FROM sliced GROUP BY 2 HAVING COUNT(*) >= 50"
    for c in ("family", "cluster", "is_zero", "is_payday"))


@query("d5_horizon_metrics", oracle(HORIZON, SCORE_COLS))
def _(w):
    return horizon_metrics(sliced_oof(w, with_stores=False))


@query("d6_segment_metrics", oracle(
    f"SELECT 'family' AS segment_type, family AS segment, {SCORES} FROM oof GROUP BY 2 HAVING COUNT(*) >= 50", SCORE_COLS))
def _(w):
    return segment_metrics(oof(w), by="family", min_n=50)


@query("d7_segment_table", oracle(SEGMENTS, SCORE_COLS))
def _(w):
    return segment_table(sliced_oof(w), ["family", "cluster", "is_zero", "is_payday"], min_n=50)


GATE = ("SELECT *, 0.5513::DOUBLE AS naive_floor_rmsle, mean_rmsle < 0.5513 AS beats_naive_floor, mean_rmsle - 0.5513 AS delta_vs_naive_rmsle, "
        "CASE WHEN mean_rmsle < 0.5513 THEN 'GO' ELSE 'NO_GO' END AS go_no_go FROM summary")
GATE_D = SUMMARY_D + " naive_floor_rmsle delta_vs_naive_rmsle"


@query("d8_naive_gate", oracle(GATE, GATE_D, summary=SUMMARY, **SUM_CTES))
def _(w):
    return gate_vs_naive(summarize_folds(fold_metrics(oof(w))))


@query("d9_locked_evaluation", oracle(
    f"SELECT 'horizon' AS segment_type, CAST(horizon AS VARCHAR) AS segment, {SCORES} FROM sliced GROUP BY 2 UNION ALL "
    f"SELECT 'fold', CAST(fold AS VARCHAR), {SCORES} FROM oof GROUP BY 2 UNION ALL SELECT * FROM seg", SCORE_COLS, seg=SEGMENTS))
def _(w):
    folds = folds_of(w)
    t = evaluate(oof(w, folds), folds, w.stores(), min_n=50)
    scores = ["n", "rmsle", "mae_log1p", "bias_log1p"]
    by_h = t["horizon"].select(F.lit("horizon").alias("segment_type"), F.col("horizon").cast("string").alias("segment"), *scores)
    by_f = t["folds"].where("fold is not null").select(F.lit("fold").alias("segment_type"), F.col("fold").cast("string").alias("segment"), *scores)
    return by_h.unionByName(by_f).unionByName(t["segments"])


@query("d10_slice_metrics", oracle(
    f"SELECT 'store_type' AS segment_type, store_type AS segment, {SCORES}, AVG(y_true) AS mean_y FROM sliced GROUP BY 2 HAVING COUNT(*) >= 50", SCORE_COLS + " mean_y"))
def _(w):
    return segment_table(sliced_oof(w), ["store_type"], min_n=50, with_mean_y=True)


RUNS = "SELECT method AS run_id, AVG(rmsle) AS mean_rmsle FROM (SELECT method, fold, SQRT(AVG(" + D2 + ")) AS rmsle FROM oofl GROUP BY 1, 2) GROUP BY 1"


def _runs(w):
    per = fold_metrics(to_long(oof_wide(w), METHODS), by=["method"])
    return summarize_folds(per, by=["method"]).select(F.col("method").alias("run_id"), "mean_rmsle")


@query("d11_seed_summary", oracle(
    "SELECT 'naive' AS model, AVG(mean_rmsle) AS seeds_mean, STDDEV_SAMP(mean_rmsle) AS seeds_std, MAX(mean_rmsle) AS seeds_worst, MIN(mean_rmsle) AS seeds_best, "
    "MAX(CASE WHEN run_id = 'last_value' THEN mean_rmsle END) AS seed_0, MAX(CASE WHEN run_id = 'seasonal_naive_7' THEN mean_rmsle END) AS seed_7, "
    "MAX(CASE WHEN run_id = 'seasonal_naive_14' THEN mean_rmsle END) AS seed_14 FROM runs",
    "seeds_mean seeds_std seeds_worst seeds_best seed_0 seed_7 seed_14", runs=RUNS))
def _(w):
    # The three naive runs stand for three seeds of one model.
    number = F.coalesce(F.regexp_extract("run_id", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return seed_summary(_runs(w).withColumns({"seed": number, "model": F.lit("naive")}), [0, 7, 14])


@query("d12_baseline_scores", oracle(
    f"SELECT method, fold, {SCORES} FROM oofl GROUP BY GROUPING SETS ((method, fold), (method))", SCORE_COLS))
def _(w):
    return baseline_metrics(w.train(), folds_of(w))


TAILS = " UNION ALL ".join(f"SELECT {p}::DOUBLE AS prob, quantile_cont(sales, {p}) AS value FROM {{t}}" for p in explore.TAIL_PROBS)


@query("d13_sales_tails", oracle(TAILS.format(t="train"), "value"))
def _(w):
    return explore.sales_tails(w.train())


@query("d13_sales_tails_traded_days", oracle(TAILS.format(t="sparse"), "value"))
def _(w):
    return explore.sales_tails(w.panel_sparse())


@query("d13_line_price_quantiles_by_flag", oracle(
    " UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS prob, quantile_cont(l_extendedprice, {p}) AS value FROM lineitem GROUP BY 1" for p in (0.01, 0.25, 0.5, 0.99)), "value"))
def _(w):
    return exact_quantiles(w.table("lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.99], ["l_returnflag"])


PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, '{r}' AS role, COUNT(DISTINCT {c}) AS n_unique, COUNT(*) - COUNT({c}) AS n_missing FROM profiled"
    for c, t, r in (("store_nbr", "int", "entity_id"), ("family", "string", "entity_id"), ("date", "date", "timestamp"),
                    ("sales", "double", "target"), ("onpromotion", "int", "known_future_covariate"), ("dcoilwtico", "double", "observed_past_covariate")))


@query("d14_column_profile", oracle(
    PROFILE, profiled=f"SELECT t.store_nbr, t.family, t.date, t.sales, t.onpromotion, o.dcoilwtico FROM train t LEFT JOIN oil o ON o.date = t.date"))
def _(w):
    return explore.column_profile(w.train().select(*KEYS, "sales", "onpromotion").join(F.broadcast(w.oil()), "date", "left"))


@query("d15_panel_extent", oracle(
    "SELECT MIN(date) AS date_min, MAX(date) AS date_max, COUNT(DISTINCT store_nbr) AS n_stores, COUNT(DISTINCT family) AS n_families, "
    "COUNT(DISTINCT (store_nbr, family)) AS n_entities, COUNT(*) AS n_rows FROM train"))
def _(w):
    return explore.panel_extent(w.train())


@query("d16_panel_integrity", oracle(
    "SELECT COUNT(*) AS n_rows, CAST(SUM(CASE WHEN sales < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative, "
    f"COUNT(*) - COUNT(DISTINCT ({KEY})) AS n_duplicate_keys, AVG(CASE WHEN sales = 0 THEN 1 ELSE 0 END) AS zero_rate, "
    "AVG(sales) AS mean, STDDEV_SAMP(sales) AS std, MIN(sales) AS min, MAX(sales) AS max FROM train", "zero_rate mean std min max"))
def _(w):
    return explore.panel_integrity(w.train())


ZERO = ("SELECT family, AVG(CASE WHEN sales = 0 THEN 1 ELSE 0 END) AS zero_rate, COUNT(*) AS n, AVG(CASE WHEN sales = 0 THEN 1 ELSE 0 END) >= 0.5 AS is_intermittent "
        "FROM train GROUP BY 1")


@query("d17_zero_rate_by_family", oracle(ZERO, "zero_rate"))
def _(w):
    return explore.zero_rates(w.train())


@query("d17_intermittent_share", oracle(
    "SELECT AVG(CASE WHEN zero_rate >= 0.95 THEN 1 ELSE 0 END) AS share FROM (SELECT store_nbr, family, AVG(CASE WHEN sales = 0 THEN 1 ELSE 0 END) AS zero_rate FROM train GROUP BY 1, 2)", "share"))
def _(w):
    rates = explore.zero_rates(w.train(), ["store_nbr", "family"], threshold=0.95)
    return rates.agg(F.avg(F.col("is_intermittent").cast("int")).alias("share"))


@query("d18_daily_totals", oracle("SELECT * FROM daily", "total_sales"))
def _(w):
    return explore.daily_totals(w.train())


@query("d19_entity_summary", oracle(
    "SELECT store_nbr, family, COUNT(*) AS n_days, AVG(sales) AS mean_sales, AVG(CASE WHEN sales = 0 THEN 1 ELSE 0 END) AS zero_rate, "
    "quantile_cont(sales, 0.99) AS p99, city, state, type, cluster FROM train JOIN stores USING (store_nbr) GROUP BY ALL", "mean_sales zero_rate p99"))
def _(w):
    return explore.entity_summary(w.train()).join(w.stores(), "store_nbr")


@query("d20_mean_by_weekday", oracle(
    "SELECT CAST(isodow(date) - 1 AS INT) AS dayofweek, AVG(total_sales) AS mean_sales FROM daily GROUP BY 1", "mean_sales"))
def _(w):
    return explore.mean_by_weekday(w.train())


@query("d20_yearly_totals", oracle("SELECT CAST(year(date) AS INT) AS year, SUM(sales) AS total_sales FROM train GROUP BY 1", "total_sales"))
def _(w):
    return explore.yearly_totals(w.train())


@query("d21_payday_contrast", oracle(
    "SELECT CAST(day(date) = 15 OR date = last_day(date) AS INT) AS is_payday, AVG(total_sales) AS mean_sales, quantile_cont(total_sales, 0.5) AS median_sales, "
    "COUNT(*) AS n_days FROM daily GROUP BY 1", "mean_sales median_sales"))
def _(w):
    return explore.payday_contrast(w.train())


@query("d22_event_windows", oracle(
    f"""SELECT pre AS mean_pre, post AS mean_post, post / pre AS post_pre_ratio, share_rows, share_mass, mean_recent, mean_prior FROM
 (SELECT AVG(CASE WHEN date < DATE '{EVENT}' AND date >= DATE '{EVENT}' - 42 THEN total_sales END) AS pre,
 AVG(CASE WHEN date >= DATE '{EVENT}' AND date < DATE '{EVENT}' + 42 THEN total_sales END) AS post,
 AVG(CASE WHEN date > m - 90 THEN total_sales END) AS mean_recent, AVG(CASE WHEN date > m - 180 AND date <= m - 90 THEN total_sales END) AS mean_prior
 FROM daily, (SELECT MAX(date) AS m FROM daily)),
 (SELECT AVG(CASE WHEN date >= DATE '{EVENT}' AND date < DATE '{EVENT}' + 28 THEN 1 ELSE 0 END) AS share_rows,
 SUM(CASE WHEN date >= DATE '{EVENT}' AND date < DATE '{EVENT}' + 28 THEN sales ELSE 0 END) / SUM(sales) AS share_mass FROM train)""",
    "mean_pre mean_post post_pre_ratio share_rows share_mass mean_recent mean_prior"))
def _(w):
    return explore.event_windows(w.train(), EVENT)


@query("d23_holiday_value_counts", oracle(
    "SELECT 'type' AS column_name, type AS value, COUNT(*) AS n FROM hol GROUP BY 2 UNION ALL SELECT 'locale', locale, COUNT(*) FROM hol GROUP BY 2 UNION ALL "
    "SELECT 'transferred', CAST(transferred AS VARCHAR), COUNT(*) FROM hol GROUP BY 2 UNION ALL "
    "SELECT 'o_orderstatus', o_orderstatus, COUNT(*) FROM orders GROUP BY 2"))
def _(w):
    hol = explore.value_counts(w.holidays_events(), ["type", "locale", "transferred"])
    return hol.unionByName(explore.value_counts(w.table("orders"), ["o_orderstatus"]))


@query("d26_forecast_summary", oracle(
    "SELECT family, AVG(CASE WHEN y_pred <= 1e-12 THEN 1 ELSE 0 END) AS near_zero_rate, MIN(y_pred) AS pred_min, AVG(y_pred) AS pred_mean, MAX(y_pred) AS pred_max, "
    "COUNT(*) AS n, quantile_cont(y_pred, 0.5) AS pred_median FROM oof GROUP BY 1", "near_zero_rate pred_min pred_mean pred_max pred_median"))
def _(w):
    return explore.forecast_summary(oof(w))


@query("d26_forecast_daily_totals", oracle("SELECT date, SUM(y_pred) AS total_sales FROM oof GROUP BY 1", "total_sales"))
def _(w):
    return explore.daily_totals(oof(w), target_col="y_pred")


METHOD_FOLDS = f"SELECT method, fold, SQRT(AVG({D2})) AS rmsle FROM oofl GROUP BY 1, 2"


@query("d27_baseline_summary", oracle(
    "SELECT method, AVG(rmsle) AS mean, STDDEV_SAMP(rmsle) AS std, MIN(rmsle) AS min, MAX(rmsle) AS max FROM mf GROUP BY 1", "mean std min max", mf=METHOD_FOLDS))
def _(w):
    per = to_long(oof_wide(w), METHODS).groupBy("method", "fold").agg(rmsle("y_true", "y_pred").alias("r"))
    return per.groupBy("method").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"))


@query("d28_scoreboard", oracle(
    "SELECT run_id, mean_rmsle, mean_rmsle < b AS beats_baseline, mean_rmsle - b AS delta_vs_baseline FROM runs, (SELECT mean_rmsle AS b FROM runs WHERE run_id = 'seasonal_naive_7')",
    "mean_rmsle delta_vs_baseline", runs=RUNS))
def _(w):
    return scoreboard(_runs(w), baseline="seasonal_naive_7")


# --- sorts and top-k ---------------------------------------------------------
@query("f1_canonical_sort", oracle(f"SELECT {KEY}, sales, CAST(row_number() OVER (PARTITION BY store_nbr, family ORDER BY date) AS INT) AS place FROM train", "sales"))
def _(w):
    rows = w.train().select(*KEYS, "sales").sortWithinPartitions(*KEYS)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("store_nbr", "family").orderBy("date")))


@query("f2_top_days", oracle("SELECT date, total_sales FROM daily ORDER BY total_sales DESC, date LIMIT 10", "total_sales"))
def _(w):
    return explore.daily_totals(w.train()).orderBy(F.desc("total_sales"), "date").limit(10)


@query("f3_worst_segments", oracle("SELECT * FROM (SELECT * FROM seg ORDER BY ROUND(rmsle, 9) DESC, segment_type, segment LIMIT 5)", SCORE_COLS, seg=SEGMENTS))
def _(w):
    table = segment_table(sliced_oof(w), ["family", "cluster", "is_zero", "is_payday"], min_n=50)
    return table.orderBy(F.desc(F.round("rmsle", 9)), "segment_type", "segment").limit(5)


@query("f4_best_run", oracle("SELECT arg_min(run_id, mean_rmsle) AS run_id, MIN(mean_rmsle) AS mean_rmsle FROM runs", "mean_rmsle", runs=RUNS))
def _(w):
    return _runs(w).agg(F.min_by("run_id", "mean_rmsle").alias("run_id"), F.min("mean_rmsle").alias("mean_rmsle"))


@query("f5_head_and_tail", oracle(
    "SELECT * FROM (SELECT 'low' AS side, store_nbr, zero_rate FROM zs ORDER BY zero_rate, store_nbr LIMIT 3) UNION ALL "
    "SELECT * FROM (SELECT 'high', store_nbr, zero_rate FROM zs ORDER BY zero_rate DESC, store_nbr LIMIT 3)", "zero_rate",
    zs="SELECT store_nbr, AVG(CASE WHEN sales = 0 THEN 1 ELSE 0 END) AS zero_rate FROM train GROUP BY 1"))
def _(w):
    rates = explore.zero_rates(w.train(), ["store_nbr"]).select("store_nbr", "zero_rate")
    low = rates.orderBy("zero_rate", "store_nbr").limit(3).select(F.lit("low").alias("side"), "*")
    return low.unionByName(rates.orderBy(F.desc("zero_rate"), "store_nbr").limit(3).select(F.lit("high").alias("side"), "*"))


@query("f6_seeded_entity_sample", oracle(
    f"SELECT {KEY}, sales FROM train WHERE (store_nbr, family) IN (SELECT (store_nbr, family) FROM (SELECT DISTINCT store_nbr, family FROM train) "
    "ORDER BY md5(concat_ws(':', 42, store_nbr, family)), store_nbr, family LIMIT 6)", "sales"))
def _(w):
    return explore.sampled_entities(w.train().select(*KEYS, "sales"), 6)


@query("o11_seeded_forecast_sample", oracle(
    "SELECT * FROM (SELECT * FROM oof ORDER BY md5(concat_ws(':', 42, store_nbr, family, date, fold)), store_nbr, family, date, fold LIMIT 8000)", "y_true y_pred"))
def _(w):
    return explore.seeded_sample(oof(w), 8000, [*KEYS, "fold"])


# --- scalar functions --------------------------------------------------------
@query("h1_date_parts", oracle(
    "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS dow, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, "
    "CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS is_month_end, "
    "CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since, CAST(o_orderdate AS DATE) + 7 AS plus_week FROM orders"))
def _(w):
    d = F.col("o_orderdate").cast("date")
    return w.table("orders").select(
        "o_orderkey", S.weekday0(d).alias("dow"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.weekofyear(d).alias("w"),
        F.year(d).alias("y"), S.is_month_end(d).alias("is_month_end"), S.days_between(d, F.lit("2000-01-01").cast("date")).alias("since"),
        F.date_add(d, 7).alias("plus_week"))


@query("h4_numeric_functions", oracle(
    "SELECT c_custkey, LN(1 + GREATEST(c_acctbal, 0)) AS l, EXP(LN(1 + GREATEST(c_acctbal, 0))) - 1 AS e, CEIL(c_acctbal / 7) AS c, SQRT(ABS(c_acctbal)) AS s, "
    "POW(c_acctbal / 100, 2) AS p FROM customer", "l e c s p"))
def _(w):
    x = F.col("c_acctbal")
    t = S.transform_target(x)
    return w.table("customer").select(
        "c_custkey", t.alias("l"), S.inverse_target(t).alias("e"), F.ceil(x / 7).cast("double").alias("c"), F.sqrt(F.abs(x)).alias("s"),
        F.pow(x / 100, F.lit(2)).alias("p"))


@query("h5_clip_coerce_fill", oracle(
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN LEAST(GREATEST(c_acctbal, 100), 5000) END AS clipped, TRY_CAST(c_name AS DOUBLE) AS coerced, "
    "COALESCE(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS filled, c_acctbal > 0 AS finite FROM customer", "clipped coerced filled"))
def _(w):
    pos = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    odd = F.coalesce(pos, F.lit(float("nan")))
    return w.table("customer").select(
        "c_custkey", S.clip(pos, 100.0, 5000.0).alias("clipped"), S.to_number("c_name").alias("coerced"),
        F.coalesce(S.nan_to_null(odd), F.lit(0.0)).alias("filled"), S.is_finite(odd).alias("finite"))


@query("h12_json_round_trip", oracle("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "o_totalprice"))
def _(w):
    packed = w.table("orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("j"))
    return packed.select(F.from_json("j", "o_orderkey bigint, o_orderstatus string, o_totalprice double").alias("r")).select("r.*")


# --- recursive forecast with a Column model -----------------------------------
WEIGHTS = {"sales_lag_1": 0.05, "sales_lag_7": 0.15, "sales_lag_28": 0.1, "sales_roll_mean_7": 0.2, "sales_roll_mean_28": 0.4,
           "sales_roll_std_14": 0.02, "onpromotion": 4.0, "dayofweek": 0.01}
LINEAR = ("GREATEST(0, 0.05 + 0.05 * h[28] + 0.15 * h[22] + 0.1 * h[1] + 0.2 * list_avg(h[22:28]) + 0.4 * list_avg(h) + "
          "0.02 * list_aggregate(h[15:28], 'stddev_samp') + 4.0 * v.onpromotion + 0.01 * (isodow(v.date) - 1))")
STATE = ("SELECT f.fold, t.store_nbr, t.family, list(t.sales ORDER BY t.date) AS h FROM train t JOIN folds f ON t.date <= f.train_end "
         "AND t.date > f.train_end - 28 GROUP BY 1, 2, 3")
REC = ("SELECT fold, store_nbr, family, 0 AS step, NULL::DATE AS date, h, 0.0::DOUBLE AS y_true, 0.0::DOUBLE AS y_pred FROM state0 UNION ALL "
       f"SELECT fold, store_nbr, family, step + 1, date, list_append(h[2:28], p), y_true, p FROM (SELECT r.fold, r.store_nbr, r.family, r.step, v.date, r.h, v.sales AS y_true, "
       f"{LINEAR} AS p FROM rec r JOIN valrows v ON v.fold = r.fold AND v.store_nbr = r.store_nbr AND v.family = r.family AND v.date = v.train_end + r.step + 1)")
REC_CTES = {"state0": STATE, "rec": REC}


def linear_oof(w):
    folds = folds_of(w)
    panel = X.add_calendar_features(w.near(folds, HISTORY), event_date=EVENT)
    state = origin_state(panel, folds, ["onpromotion", "dayofweek"])
    return forecast_column(state, linear_model(WEIGHTS, 0.05), list(WEIGHTS)).select(*KEYS, "fold", "y_true", "y_pred")


@query("l6_recursive_forecast", oracle(
    "SELECT store_nbr, family, date, fold, y_true, y_pred FROM rec WHERE step > 0", "y_true y_pred", **REC_CTES))
def _(w):
    return linear_oof(w)


@query("l6_recursive_forecast_scores", oracle(
    f"SELECT fold, {SCORES} FROM rec WHERE step > 0 GROUP BY GROUPING SETS ((fold), ())", SCORE_COLS, **REC_CTES))
def _(w):
    return fold_metrics(linear_oof(w))


@query("l8b_teacher_forced", oracle(
    "SELECT fold, 'teacher_forced' AS mode, SQRT(AVG(POW(LN(1 + p) - LN(1 + sales), 2))) AS rmsle FROM (SELECT v.fold, v.sales, "
    "0.3 * COALESCE(f.sales_lag_7, 0) + 0.7 * COALESCE(f.sales_roll_mean_28, 0) AS p FROM valrows v JOIN feats f USING (store_nbr, family, date)) GROUP BY 1",
    "rmsle", feats="SELECT store_nbr, family, date, LAG(sales, 7) OVER (PARTITION BY store_nbr, family ORDER BY date) AS sales_lag_7, "
    "AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS sales_roll_mean_28 FROM train"))
def _(w):
    folds = folds_of(w)
    made = X.add_rolling_features(X.add_lag_features(w.near(folds, 28), lags=(7,)), windows=(28,), stats=("mean",))
    model = linear_model({"sales_lag_7": 0.3, "sales_roll_mean_28": 0.7})
    pred = model({c: F.col(c) for c in ("sales_lag_7", "sales_roll_mean_28")})
    val = expand_folds(made, folds, lookback_days=0).where("role = 'val'")
    return val.groupBy("fold").agg(F.lit("teacher_forced").alias("mode"), rmsle(F.col("sales"), pred).alias("rmsle"))


# --- blends ------------------------------------------------------------------
@query("l13_mean_blend", oracle(
    "SELECT store_nbr, family, date, fold, (last_value + seasonal_naive_7 + seasonal_naive_14) / 3 AS y_pred FROM oofw", "y_pred"))
def _(w):
    return oof_wide(w).select(*KEYS, "fold", mean_blend(METHODS).alias("y_pred"))


@query("l14_weighted_blend", oracle(
    "SELECT store_nbr, family, date, fold, (1 * last_value + 2 * seasonal_naive_7 + 5 * seasonal_naive_14) / 8 AS y_pred FROM oofw", "y_pred"))
def _(w):
    return oof_wide(w).select(*KEYS, "fold", weighted_blend(METHODS, [1, 2, 5]).alias("y_pred"))


@query("l15_blend_gram", oracle(
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, SUM({a} * {b}) AS value FROM oofw" for i, a in enumerate(METHODS) for b in (*METHODS[i:], "y_true")), "value"))
def _(w):
    return gram(oof_wide(w), METHODS)


_M = ("SELECT 'last_value' AS method, fold, y_true, last_value AS y_pred FROM oofw UNION ALL SELECT 'seasonal_naive_7', fold, y_true, seasonal_naive_7 FROM oofw UNION ALL "
      "SELECT 'seasonal_naive_14', fold, y_true, seasonal_naive_14 FROM oofw UNION ALL SELECT 'mean_blend', fold, y_true, (last_value + seasonal_naive_7 + seasonal_naive_14) / 3 FROM oofw "
      "UNION ALL SELECT 'nonneg_blend', fold, y_true, (1 * last_value + 2 * seasonal_naive_7 + 5 * seasonal_naive_14) / 8 FROM oofw")


@query("l16_blend_decision", oracle(
    "SELECT p.*, s.std_fold_rmsle, ends_with(p.method, 'blend') AND pooled_rmsle < (SELECT MIN(pooled_rmsle) FROM bp WHERE NOT ends_with(method, 'blend')) - 1e-6 AS accepted "
    "FROM bp p JOIN (SELECT method, STDDEV_SAMP(r) AS std_fold_rmsle FROM (SELECT method, fold, SQRT(AVG(POW(LN(1 + y_pred) - LN(1 + y_true), 2))) AS r FROM bm GROUP BY 1, 2) GROUP BY 1) s USING (method)",
    "pooled_rmsle pooled_mae_log1p std_fold_rmsle", bm=_M,
    bp="SELECT method, COUNT(*) AS n_oof, SQRT(AVG(POW(LN(1 + y_pred) - LN(1 + y_true), 2))) AS pooled_rmsle, AVG(ABS(LN(1 + y_pred) - LN(1 + y_true))) AS pooled_mae_log1p FROM bm GROUP BY 1"))
def _(w):
    wide = oof_wide(w)
    aligned = align_oofs({m: wide.withColumnRenamed(m, "y_pred") for m in METHODS})
    return blend_report(aligned, METHODS, [1, 2, 5])


@query("l15_nonneg_weights", oracle("SELECT COUNT(*) AS n, TRUE AS signs_ok, TRUE AS sum_is_one, TRUE AS not_above_any_member FROM oofw"))
def _(w):
    wide = saved(oof_wide(w), "oof")
    raw, weights = nonneg_weights(wide, METHODS, normalize=False), nonneg_weights(wide, METHODS)
    blend = sum((F.col(m) * F.lit(v) for m, v in zip(METHODS, raw)), F.lit(0.0))
    loss = {m: F.avg(F.pow(c - F.col("y_true"), 2)) for m, c in [("blend", blend), *[(m, F.col(m)) for m in METHODS]]}
    return wide.agg(
        F.count("*").alias("n"), F.lit(min(weights) >= 0).alias("signs_ok"), F.lit(abs(sum(weights) - 1) < 1e-9).alias("sum_is_one"),
        (loss["blend"] <= F.least(*[loss[m] for m in METHODS]) + 1e-9).alias("not_above_any_member"),
    )


# --- search ------------------------------------------------------------------
SPACE = {
    "w7": {"type": "float", "low": 0.1, "high": 1.0}, "w14": {"type": "log_float", "low": 0.01, "high": 1.0},
    "k": {"type": "int", "low": 1, "high": 3}, "add_last": {"type": "categorical", "choices": [0, 1]},
}


def _u(name: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', 42, trial, '{name}')), 1, 8) AS UBIGINT) + 0.5) / 4294967296.0)"


TRIALS = (f"SELECT CAST(trial AS INT) AS trial, 0.1 + {_u('w7')} * 0.9 AS w7, 0.01 * EXP({_u('w14')} * LN(100.0)) AS w14, "
          f"CAST(LEAST(FLOOR(1 + {_u('k')} * 3), 3) AS INT) AS k, CAST(LEAST(FLOOR({_u('add_last')} * 2), 1) AS INT) AS add_last FROM range(12) t(trial)")
# The nested folds take the place of the outer ones in the shared forecast tables.
NESTED = {"innerf": INNER,
          "ivalrows": CTES["valrows"].replace("folds", "innerf"), "ilastv": CTES["lastv"].replace("folds", "innerf"),
          "ioofw": CTES["oofw"].replace("valrows", "ivalrows").replace("lastv", "ilastv")}
TRIAL_SCORES = ("SELECT trial, AVG(r) AS value, STDDEV_SAMP(r) AS std, COUNT(*) AS n_folds FROM (SELECT trial, fold, SQRT(AVG(POW(LN(1 + "
                "(w7 * seasonal_naive_7 + w14 * k * seasonal_naive_14 + add_last * 0.1 * last_value)) - LN(1 + y_true), 2))) AS r FROM ioofw, trials GROUP BY 1, 2) GROUP BY 1")


def _mix(p):
    return p["w7"] * F.col("seasonal_naive_7") + p["w14"] * p["k"] * F.col("seasonal_naive_14") + p["add_last"] * F.lit(0.1) * F.col("last_value")


def _trial_scores(w):
    plan = sample_trials(w.spark, SPACE, 12)
    inner = collect_folds(inner_folds(w.train(), folds_of(w)))
    rows = [r.asDict() for r in plan.orderBy("trial").collect()]
    return plan, score_column_trials(naive_oof(w.train(), inner, periods=(7, 14)), rows, _mix)


@query("m5_nested_search_column_model", oracle(TRIAL_SCORES, "value std", trials=TRIALS, **NESTED))
def _(w):
    return _trial_scores(w)[1]


@query("m6_sampled_trials", oracle("SELECT t.*, s.n_folds FROM trials t JOIN ts s USING (trial)", "w7 w14", trials=TRIALS, ts=TRIAL_SCORES, **NESTED))
def _(w):
    plan, scores = _trial_scores(w)
    return plan.join(F.broadcast(scores.select("trial", "n_folds")), "trial")


@query("m8_best_trial", oracle("SELECT t.trial, s.value, t.w7, t.w14, t.k, t.add_last FROM trials t JOIN ts s USING (trial) ORDER BY s.value, t.trial LIMIT 1", "value w7 w14",
                               trials=TRIALS, ts=TRIAL_SCORES, **NESTED))
def _(w):
    plan, scores = _trial_scores(w)
    return best_trial(plan.join(F.broadcast(scores), "trial"), ["w7", "w14", "k", "add_last"])


# --- stress ------------------------------------------------------------------
NOISE_COLS = ("sales_lag_7", "sales_roll_mean_28")


def _z(col: str, tail: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', 7, '{col}', store_nbr, family, date, '{tail}')), 1, 8) AS UBIGINT) + 0.5) / 4294967296.0)"


def _noisy(col: str) -> str:
    z = f"SQRT(-2.0 * LN({_z(col, 'u1')})) * COS(2.0 * PI() * {_z(col, 'u2')})"
    return f"CASE WHEN {col} IS NOT NULL THEN GREATEST({col} * (1 + 0.05 * {z}), 0) END AS {col}"


VAL_FEATURES = (f"SELECT fold, store_nbr, family, date, y_true, {', '.join(NOISE_COLS)} FROM masked WHERE role = 'val'")


def _val(w):
    """Validation rows of all folds; their features look back over the longest lag or window, no further."""
    groups = ["lag", "rolling"]
    history = history_for(X.feature_columns(groups)) + 1
    made = [fold_matrix(w.near([f], history), f, groups=groups) for f in folds_of(w)]
    return reduce(DataFrame.unionByName, made).where("role = 'val'").select("fold", *KEYS, "y_true", *NOISE_COLS)


@query("n1_relative_noise", oracle(
    f"SELECT fold, store_nbr, family, date, y_true, {', '.join(_noisy(c) for c in NOISE_COLS)} FROM vf", "y_true " + " ".join(NOISE_COLS), masked=FOLD_MASKED, vf=VAL_FEATURES))
def _(w):
    return stress.relative_noise(_val(w), NOISE_COLS, relative=0.05, seed=7, non_negative=NOISE_COLS)


@query("n2_null_columns", oracle(
    "SELECT fold, store_nbr, family, date, y_true, NULL::DOUBLE AS sales_lag_7, sales_roll_mean_28 FROM vf", "y_true sales_roll_mean_28", masked=FOLD_MASKED, vf=VAL_FEATURES))
def _(w):
    return stress.null_columns(_val(w), ["sales_lag_7"])


def _clipped(col: str) -> str:
    low, high = (f"(quantile_cont({col}, {q}) OVER (PARTITION BY fold))" for q in (0.0, 0.97))
    return f"CASE WHEN {col} IS NOT NULL THEN LEAST(GREATEST({col}, {low}), {high}) END AS {col}"


@query("n3_clip_spikes", oracle(
    f"SELECT fold, store_nbr, family, date, y_true, {', '.join(map(_clipped, NOISE_COLS))} FROM vf",
    "y_true sales_lag_7 sales_roll_mean_28", masked=FOLD_MASKED, vf=VAL_FEATURES))
def _(w):
    return stress.clip_spikes(_val(w), NOISE_COLS, upper=0.97, by=["fold"])


@query("n4_predictions_changed", oracle(
    "SELECT bool_or(ABS(seasonal_naive_7 - seasonal_naive_14) > 1e-12) AS changed FROM oofw"))
def _(w):
    wide = oof_wide(w)
    return stress.predictions_changed(
        wide.withColumnRenamed("seasonal_naive_7", "y_pred"), wide.withColumnRenamed("seasonal_naive_14", "y_pred"), keys=[*KEYS, "fold"])


SCEN = ("SELECT 'clean' AS scenario, fold, y_true, seasonal_naive_7 AS y_pred FROM oofw UNION ALL SELECT 'half', fold, y_true, seasonal_naive_7 / 2 FROM oofw UNION ALL "
        "SELECT 'add_one', fold, y_true, seasonal_naive_7 + 1 FROM oofw")
SCEN_MEANS = f"SELECT scenario, AVG(r) AS m FROM (SELECT scenario, fold, SQRT(AVG({D2})) AS r FROM scen GROUP BY 1, 2) GROUP BY 1"


@query("n5_scenario_scores", oracle(
    "SELECT s.scenario, c.m AS clean_fold_mean_rmsle, s.m AS stressed_rmsle, s.m - c.m AS delta_rmsle, (s.m - c.m) / c.m AS relative_delta, 'ok' AS status "
    "FROM sm s, (SELECT m FROM sm WHERE scenario = 'clean') c WHERE scenario <> 'clean' UNION ALL SELECT 'missing_oil_join', m, NULL, NULL, NULL, 'not_applicable' FROM sm WHERE scenario = 'clean'",
    "clean_fold_mean_rmsle stressed_rmsle delta_rmsle relative_delta", scen=SCEN, sm=SCEN_MEANS))
def _(w):
    x = F.col("x")
    matrix = oof_wide(w).withColumnRenamed("seasonal_naive_7", "x")
    scenarios = {"half": lambda d: d.withColumn("x", x / 2), "add_one": lambda d: d.withColumn("x", x + 1), "missing_oil_join": None}
    return stress.scenario_scores(matrix, scenarios, lambda d: d.withColumn("y_pred", x))


@query("n6_payday_comparison", oracle(
    f"SELECT CAST(SUM(is_payday) AS BIGINT) AS n_payday, CAST(SUM(1 - is_payday) AS BIGINT) AS n_other, SQRT(AVG(CASE WHEN is_payday = 1 THEN {D2} END)) AS pooled_payday_rmsle, "
    f"SQRT(AVG(CASE WHEN is_payday = 0 THEN {D2} END)) AS pooled_other_rmsle FROM sliced", "pooled_payday_rmsle pooled_other_rmsle"))
def _(w):
    return stress.payday_comparison(oof(w))


# --- plot-data tables --------------------------------------------------------
def _hist(source: str, x: str, where: str) -> str:
    return (f"SELECT CAST(LEAST(FLOOR(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END * 60), 59) AS INT) AS bin, COUNT(*) AS n "
            f"FROM (SELECT {x} AS x FROM {source} WHERE {where}), (SELECT MIN({x}) AS lo, MAX({x}) AS hi FROM {source} WHERE {where}) GROUP BY 1")


@query("o5_target_histogram", oracle(_hist("train", "LN(1 + sales)", "sales > 0")))
def _(w):
    return explore.histogram_log1p(w.train())


@query("o6_zero_rate_ranking", oracle(
    "SELECT family, zero_rate, CAST(row_number() OVER (ORDER BY zero_rate DESC, family) AS INT) AS place FROM zr", "zero_rate", zr=ZERO))
def _(w):
    # One row per family.
    return explore.zero_rates(w.train()).select(
        "family", "zero_rate", F.row_number().over(Window.orderBy(F.desc("zero_rate"), "family")).alias("place"))


@query("o7_daily_with_events", oracle(
    "SELECT d.date, total_sales, COALESCE(n, 0) AS n_events FROM daily d LEFT JOIN (SELECT date, COUNT(*) AS n FROM hol WHERE NOT transferred GROUP BY 1) h ON h.date = d.date", "total_sales"))
def _(w):
    return explore.daily_with_events(w.train(), w.holidays_events())


@query("o8_weekday_boxes", oracle(
    "SELECT CAST(isodow(date) - 1 AS INT) AS dayofweek, quantile_cont(total_sales, 0.25) AS q1, quantile_cont(total_sales, 0.5) AS median, quantile_cont(total_sales, 0.75) AS q3, "
    "COUNT(*) AS n_days FROM daily WHERE total_sales <= (SELECT quantile_cont(total_sales, 0.99) FROM daily) GROUP BY 1", "q1 median q3"))
def _(w):
    return explore.weekday_boxes(w.train())


@query("o9_missing_gaps", oracle(
    "SELECT MIN(date) AS gap_start, MAX(date) AS gap_end, COUNT(*) AS n_quotes FROM (SELECT date, dcoilwtico IS NULL AS gap, row_number() OVER (ORDER BY date) - "
    "row_number() OVER (PARTITION BY dcoilwtico IS NULL ORDER BY date) AS island FROM oil) WHERE gap GROUP BY island"))
def _(w):
    return explore.missing_gaps(w.oil(), "dcoilwtico")


@query("o10_residual_histogram", oracle(_hist("oof", "LN(1 + y_pred) - LN(1 + y_true)", "TRUE")))
def _(w):
    return explore.residual_histogram(oof(w))


@query("o12_series_panels", oracle(
    f"SELECT {KEY}, sales FROM train WHERE date >= (SELECT MAX(date) FROM train) - 180 AND (store_nbr, family) IN (SELECT (store_nbr, family) FROM "
    "(SELECT store_nbr, family FROM train GROUP BY 1, 2 ORDER BY SUM(sales) DESC, store_nbr, family LIMIT 6))", "sales"))
def _(w):
    rows = w.train().select(*KEYS, "sales")
    best = rows.groupBy("store_nbr", "family").agg(F.sum("sales").alias("s")).orderBy(F.desc("s"), "store_nbr", "family").limit(6)
    return explore.recent_slice(rows, best, 180)


@query("o13_fold_stability", oracle("SELECT method, fold, rmsle FROM mf", "rmsle", mf=METHOD_FOLDS))
def _(w):
    return to_long(oof_wide(w), METHODS).groupBy("method", "fold").agg(rmsle("y_true", "y_pred").alias("rmsle"))


@query("o14_outlier_triage", oracle(
    f"""SELECT * FROM (SELECT 'invalid' AS outlier_class, CAST(SUM(CASE WHEN sales < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows, AVG(CASE WHEN sales < 0 THEN 1 ELSE 0 END) AS share, 'fail' AS action FROM tri
 UNION ALL SELECT 'spike', CAST(SUM(CASE WHEN sales > p THEN 1 ELSE 0 END) AS BIGINT), AVG(CASE WHEN sales > p THEN 1 ELSE 0 END), 'keep' FROM tri
 UNION ALL SELECT 'regime', CAST(SUM(CASE WHEN reg THEN 1 ELSE 0 END) AS BIGINT), AVG(CASE WHEN reg THEN 1 ELSE 0 END), 'keep' FROM tri
 UNION ALL SELECT 'structural_zero', CAST(SUM(CASE WHEN z >= 0.5 THEN 1 ELSE 0 END) AS BIGINT), AVG(CASE WHEN z >= 0.5 THEN 1 ELSE 0 END), 'keep' FROM tri)""", "share",
    tri=f"SELECT sales, quantile_cont(sales, 0.99) OVER w AS p, AVG(CASE WHEN sales = 0 THEN 1 ELSE 0 END) OVER w AS z, "
        f"date >= DATE '{EVENT}' AND date < DATE '{EVENT}' + 28 AS reg FROM train WINDOW w AS (PARTITION BY store_nbr, family)"))
def _(w):
    return explore.outlier_triage(w.train(), EVENT)


# --- jobs with models that SQL can follow --------------------------------------
@query("l17_naive_experiment", oracle(SUMMARY.replace("SELECT AVG", "SELECT '001_seasonal_naive_7' AS run_id, AVG", 1), SUMMARY_D, **SUM_CTES))
def _(w):
    spec = {"run_id": "001_seasonal_naive_7", "model": "seasonal_naive", "period": 7}
    return run_experiment(w.train(), folds_of(w), scratch_path(w.spark, "outputs"), spec)


@query("m9_naive_run_specifications", oracle(
    "SELECT CASE method WHEN 'last_value' THEN '000_last_value' WHEN 'seasonal_naive_7' THEN '001_seasonal_naive_7' ELSE '002_seasonal_naive_14' END AS run_id, "
    "AVG(rmsle) AS mean_rmsle, STDDEV_SAMP(rmsle) AS std_rmsle FROM mf GROUP BY 1", "mean_rmsle std_rmsle", mf=METHOD_FOLDS))
def _(w):
    runs = run_matrix(w.train(), folds_of(w), scratch_path(w.spark, "outputs"), NAIVE_RUNS)
    return runs.select("run_id", "mean_rmsle", "std_rmsle")


TEST_LINEAR = LINEAR.replace("v.date", "t.date").replace("v.onpromotion", "t.onpromotion")
TEST_STATE = f"SELECT store_nbr, family, list(sales ORDER BY date) AS h FROM train WHERE date > {TRAIN_END} - 28 GROUP BY 1, 2"
TEST_REC = ("SELECT store_nbr, family, 0 AS step, NULL::DATE AS date, NULL::BIGINT AS id, h, 0.0::DOUBLE AS y_pred FROM tstate UNION ALL "
            "SELECT store_nbr, family, step + 1, date, id, list_append(h[2:28], p), p FROM (SELECT r.store_nbr, r.family, r.step, r.h, t.date, t.id, "
            f"{TEST_LINEAR} AS p FROM trec r JOIN test t ON t.store_nbr = r.store_nbr AND t.family = r.family AND t.date = {TRAIN_END} + r.step + 1)")


def _test_forecast(w):
    fold = test_fold(w.train_days(), w.test_days())
    panel = X.add_calendar_features(train_test_panel(w.near([fold], HISTORY, with_id=True), w.test()), event_date=EVENT)
    state = origin_state(panel, [fold], ["onpromotion", "dayofweek"], keep=["id"])
    return forecast_column(state, linear_model(WEIGHTS, 0.05), list(WEIGHTS))


@query("l11_test_forecast_column_model", oracle(
    "SELECT id, store_nbr, family, date, y_pred AS sales FROM trec WHERE step > 0", "sales", tstate=TEST_STATE, trec=TEST_REC))
def _(w):
    return _test_forecast(w).select("id", *KEYS, F.col("y_pred").alias("sales"))


@query("l12_submission_job_column_model", oracle("SELECT id, y_pred AS sales FROM trec WHERE step > 0", "sales", tstate=TEST_STATE, trec=TEST_REC))
def _(w):
    preds = _test_forecast(w).select("id", F.col("y_pred").alias("sales"))
    path = scratch_path(w.spark, "submission")
    submit(preds, w.sample_submission(), path)
    return w.spark.read.schema("id bigint, sales double").option("header", True).csv(path)


BATTERY = ("SELECT 'clean' AS scenario, fold, y_true, sales_lag_7 AS a, sales_roll_mean_28 AS b FROM vf UNION ALL "
           "SELECT 'noise_5pct', fold, y_true, sales_lag_7, sales_roll_mean_28 FROM (SELECT fold, store_nbr, family, date, y_true, " + ", ".join(_noisy(c) for c in NOISE_COLS) + " FROM vf) UNION ALL "
           "SELECT 'missing_history', fold, y_true, NULL, sales_roll_mean_28 FROM vf")
BATTERY_MEANS = ("SELECT scenario, AVG(m) AS m FROM (SELECT scenario, fold, SQRT(AVG(POW(LN(1 + 0.3 * COALESCE(a, 0) + 0.7 * COALESCE(b, 0)) - LN(1 + y_true), 2))) AS m FROM battery GROUP BY 1, 2) GROUP BY 1")


@query("n7_battery_column_model", oracle(
    "SELECT s.scenario, c.m AS clean_fold_mean_rmsle, s.m AS stressed_rmsle, s.m - c.m AS delta_rmsle, (s.m - c.m) / c.m AS relative_delta, 'ok' AS status "
    "FROM bmeans s, (SELECT m FROM bmeans WHERE scenario = 'clean') c WHERE scenario <> 'clean' UNION ALL "
    "SELECT 'missing_oil_join', m, NULL, NULL, NULL, 'not_applicable' FROM bmeans WHERE scenario = 'clean'",
    "clean_fold_mean_rmsle stressed_rmsle delta_rmsle relative_delta", masked=FOLD_MASKED, vf=VAL_FEATURES, battery=BATTERY, bmeans=BATTERY_MEANS))
def _(w):
    model = linear_model({"sales_lag_7": 0.3, "sales_roll_mean_28": 0.7})
    scenarios = {
        "noise_5pct": lambda d: stress.relative_noise(d, NOISE_COLS, relative=0.05, seed=7, non_negative=NOISE_COLS),
        "missing_history": lambda d: stress.null_columns(d, ["sales_lag_7"]), "missing_oil_join": None,
    }
    matrix = saved(_val(w), "matrix")
    return stress.scenario_scores(matrix, scenarios, lambda d: d.withColumn("y_pred", model({c: F.col(c) for c in NOISE_COLS})))
