"""Exploration and diagnostic tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.quantiles import exact_quantiles
from tidepanel.functions.scalars import clip, is_finite, is_payday, weekday0
from tidepanel.sources.schemas import ENTITY

# Tail probabilities of the sales description.
TAIL_PROBS = (0.0, 0.5, 0.9, 0.95, 0.99, 0.995, 0.999, 1.0)


def sales_tails(df: DataFrame, target_col: str = "sales", probs: Sequence[float] = TAIL_PROBS) -> DataFrame:
    return exact_quantiles(df, target_col, probs)


# Semantic role of each column.
COLUMN_ROLES: Mapping[str, str] = {
    "id": "row_id", "date": "timestamp", "store_nbr": "entity_id", "family": "entity_id",
    "sales": "target", "onpromotion": "known_future_covariate",
    "dcoilwtico": "observed_past_covariate", "transactions": "observed_past_covariate",
    "city": "static_covariate", "state": "static_covariate", "type": "static_covariate",
    "cluster": "static_covariate",
}


def column_profile(df: DataFrame, roles: Mapping[str, str] = COLUMN_ROLES, *, approximate: bool = False) -> DataFrame:
    """Distinct and missing counts per column.

    Each column is counted by value and the values are counted again: both steps are hash
    aggregates, a hot value collapses map-side, and a columnar scan reads every column once in all.
    ``approximate`` takes one pass over all columns with distinct-count sketches instead.
    """
    kinds = dict(df.dtypes)

    def described(counts: DataFrame, name: str) -> DataFrame:
        return counts.select(
            F.lit(name).alias("column_name"), F.lit(kinds[name]).alias("dtype"), F.lit(roles.get(name, "other")).alias("role"),
            "n_unique", "n_missing")

    if approximate:
        both = [F.struct(F.approx_count_distinct(c).alias("n_unique"), F.count_if(F.col(c).isNull()).alias("n_missing")).alias(c) for c in df.columns]
        row = df.agg(*both)
        return reduce(DataFrame.unionByName, [described(row.select(f"`{c}`.*"), c) for c in df.columns])
    parts = []
    for c in df.columns:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        counts = values.agg(F.count("v").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))
        parts.append(described(counts, c))
    return reduce(DataFrame.unionByName, parts)


def panel_extent(df: DataFrame, entity_cols: Sequence[str] = ENTITY, date_col: str = "date") -> DataFrame:
    """Date bounds and numbers of stores, families and entities.

    Rows shrink to one per entity first; the distinct counts then run on entities.
    """
    store, family = entity_cols
    per_entity = df.groupBy(store, family).agg(
        F.min(date_col).alias("lo"), F.max(date_col).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return per_entity.agg(
        F.min("lo").alias("date_min"), F.max("hi").alias("date_max"),
        F.count_distinct(store).alias("n_stores"), F.count_distinct(family).alias("n_families"),
        F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_rows"),
    )


def _day_set(date_col: str) -> tuple[Column, Column]:
    """Group key and aggregate that hold the distinct dates of a group as bits, 64 days to a long."""
    n = F.unix_date(date_col)
    # Shifts take the lowest six bits of their count, so days before 1970 fall in place as well.
    return F.floor(n / 64).alias("_span"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(64)))).alias("_days")


def _days_in(bits: Column) -> Column:
    """Distinct dates of a group; one without a date holds NULL alone."""
    return F.coalesce(F.bit_count(bits), F.lit(1))


def panel_integrity(df: DataFrame, entity_cols: Sequence[str] = ENTITY, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """Negatives, duplicate keys, zero rate and moments, over one aggregate per entity and 64 days."""
    y = F.col(target_col)
    span, days = _day_set(date_col)
    per_span = df.groupBy(*entity_cols, span).agg(
        F.count(F.lit(1)).alias("n"), days, F.count_if(y < 0).alias("neg"), F.count_if(y == 0).alias("zero"),
        F.sum(y).alias("s"), F.sum(y * y).alias("ss"), F.min(y).alias("lo"), F.max(y).alias("hi"),
    )
    n = F.sum("n")
    return per_span.agg(
        n.alias("n_rows"), F.sum("neg").alias("n_negative"),
        F.sum(F.col("n") - _days_in(F.col("_days"))).alias("n_duplicate_keys"),
        (F.sum("zero") / n).alias("zero_rate"), (F.sum("s") / n).alias("mean"),
        F.sqrt((F.sum("ss") - F.sum("s") * F.sum("s") / n) / (n - 1)).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"),
    )


def zero_rates(df: DataFrame, by: Sequence[str] = ("family",), target_col: str = "sales", threshold: float = 0.5) -> DataFrame:
    """Intermittency per group, with a flag for groups that are mostly zero."""
    rate = F.avg((F.col(target_col) == 0).cast("int"))
    return df.groupBy(*by).agg(rate.alias("zero_rate"), F.count(F.lit(1)).alias("n")).withColumn(
        "is_intermittent", F.col("zero_rate") >= threshold
    )


def daily_totals(df: DataFrame, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    return df.groupBy(date_col).agg(F.sum(target_col).alias("total_sales"))


def daily_with_events(df: DataFrame, holidays: DataFrame, date_col: str = "date") -> DataFrame:
    """Daily totals beside the number of celebrated events of the day."""
    events = holidays.where(~F.col("transferred")).groupBy(date_col).agg(F.count(F.lit(1)).alias("n"))
    return daily_totals(df, date_col).join(events, date_col, "left").select(
        date_col, "total_sales", F.coalesce("n", F.lit(0)).alias("n_events")
    )


def entity_summary(df: DataFrame, entity_cols: Sequence[str] = ENTITY, target_col: str = "sales") -> DataFrame:
    """Days, mean, zero rate and p99 per entity.

    The exact percentile buffers one entity's values: at most one per calendar day.
    """
    y = F.col(target_col)
    return df.groupBy(*entity_cols).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(y).alias("mean_sales"),
        F.avg((y == 0).cast("int")).alias("zero_rate"), F.percentile(y, 0.99).alias("p99"),
    )


def spikes_above_p99(df: DataFrame, entity_cols: Sequence[str] = ENTITY, target_col: str = "sales") -> DataFrame:
    """Rows above their own entity's 99th percentile, as count and share."""
    w = Window.partitionBy(*entity_cols)
    flagged = df.withColumn("_p99", F.percentile(target_col, 0.99).over(w))
    above = (F.col(target_col) > F.col("_p99")).cast("int")
    return flagged.agg(F.sum(above).alias("n_above"), F.avg(above).alias("share_above"))


def mean_by_weekday(df: DataFrame, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """Mean national daily total per weekday."""
    return daily_totals(df, date_col, target_col).groupBy(weekday0(date_col).alias("dayofweek")).agg(
        F.avg("total_sales").alias("mean_sales"))


def yearly_totals(df: DataFrame, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    return df.groupBy(F.year(date_col).alias("year")).agg(F.sum(target_col).alias("total_sales"))


def payday_contrast(df: DataFrame, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """Mean, median and number of daily totals on paydays and other days (one row per day)."""
    return daily_totals(df, date_col, target_col).groupBy(is_payday(date_col).alias("is_payday")).agg(
        F.avg("total_sales").alias("mean_sales"), F.percentile("total_sales", 0.5).alias("median_sales"),
        F.count(F.lit(1)).alias("n_days"),
    )


def event_windows(df: DataFrame, event_date: str, *, near: int = 42, share_days: int = 28, recent: int = 90,
                  date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """Daily level around an event, share of rows and mass after it, last days against those before.

    Rows shrink to one per day first, so the window that finds the last day is calendar-bound.
    """
    daily = df.groupBy(F.col(date_col).alias("d")).agg(
        F.sum(target_col).alias("s"), F.count(F.lit(1)).alias("n"))
    day = daily.withColumn("last", F.max("d").over(Window.partitionBy()))
    off = F.datediff(F.col("d"), F.lit(event_date).cast("date"))
    age = F.datediff(F.col("last"), F.col("d"))

    def level(cond):
        return F.avg(F.when(cond, F.col("s")))

    pre, post = level(off.between(-near, -1)), level(off.between(0, near - 1))
    window = off.between(0, share_days - 1)
    return day.agg(
        pre.alias("mean_pre"), post.alias("mean_post"), (post / pre).alias("post_pre_ratio"),
        (F.sum(F.when(window, F.col("n"))) / F.sum("n")).alias("share_rows"),
        (F.sum(F.when(window, F.col("s"))) / F.sum("s")).alias("share_mass"),
        level(age < recent).alias("mean_recent"),
        level((age >= recent) & (age < 2 * recent)).alias("mean_prior"),
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts of each value of several columns in one long table."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(cells).alias("c")).groupBy("c.column_name", "c.value").agg(
        F.count(F.lit(1)).alias("n"))


def sales_by_store_attribute(df: DataFrame, stores: DataFrame, cols: Sequence[str] = ("type", "cluster")) -> DataFrame:
    """Mean sales per store type and cluster; stores are summed up before the join."""
    per_store = df.groupBy("store_nbr").agg(F.sum("sales").alias("s"), F.count("sales").alias("n"))
    cells = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in cols])
    return per_store.join(stores, "store_nbr").select("s", "n", F.explode(cells).alias("c")).groupBy(
        "c.attribute", "c.value").agg((F.sum("s") / F.sum("n")).alias("mean_sales"))


def transaction_coverage(panel: DataFrame, tx: DataFrame) -> DataFrame:
    """Share of store-days that have a transactions row; a store's days are bits, 64 to a row."""
    span, days = _day_set("date")
    keys = ["store_nbr", "_span"]
    wanted = panel.groupBy("store_nbr", span).agg(days)
    seen = tx.groupBy("store_nbr", span).agg(days.alias("_seen"))
    n = F.sum(_days_in(F.col("_days")))
    hits = F.sum(F.coalesce(F.bit_count(F.col("_days").bitwiseAND(F.col("_seen"))), F.lit(0)))
    return wanted.join(seen, keys, "left").agg(F.coalesce(n, F.lit(0)).alias("n_store_days"), (hits / n).alias("coverage"))


def histogram_log1p(df: DataFrame, col: str = "sales", bins: int = 60) -> DataFrame:
    """Equal-width bins of log1p of the positive values, empty bins left out."""
    x = df.where(F.col(col) > 0).select(F.log1p(col).alias("x"))
    return _histogram(x, bins)


def residual_histogram(oof: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", bins: int = 60) -> DataFrame:
    """Bins of the finite log1p residuals."""
    r = F.log1p(clip(y_pred, lower=0.0)) - F.log1p(clip(y_true, lower=0.0))
    return _histogram(oof.select(r.alias("x")).where(is_finite("x")), bins)


def _histogram(x: DataFrame, bins: int) -> DataFrame:
    # The bounds are one aggregated row, read as scalar subqueries.
    bounds = x.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    placed = x.withColumn("_b", bounds)
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    raw = F.floor(F.when(hi > lo, (F.col("x") - lo) / (hi - lo)).otherwise(0.0) * bins)
    bucket = F.least(raw, F.lit(bins - 1)).cast("int")
    return placed.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def weekday_boxes(df: DataFrame, cap: float = 0.99, date_col: str = "date", target_col: str = "sales") -> DataFrame:
    """Quartiles of daily totals by weekday, days above an upper quantile left out.

    Percentiles and window work on one row per day.
    """
    daily = daily_totals(df, date_col, target_col).withColumn(
        "_cap", F.percentile("total_sales", cap).over(Window.partitionBy()))
    y = F.col("total_sales")
    return daily.where(y <= F.col("_cap")).groupBy(weekday0(date_col).alias("dayofweek")).agg(
        *[F.percentile(y, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))],
        F.count(F.lit(1)).alias("n_days"),
    )


def missing_gaps(series: DataFrame, value_col: str, date_col: str = "date") -> DataFrame:
    """Runs of missing values in a daily series (one row per date): start, end, length."""
    order = Window.orderBy(date_col)
    marked = series.select(
        date_col, F.col(value_col).isNull().alias("gap"),
        (F.row_number().over(order)
         - F.row_number().over(Window.partitionBy(F.col(value_col).isNull()).orderBy(date_col))).alias("island"),
    )
    return marked.where("gap").groupBy("island").agg(
        F.min(date_col).alias("gap_start"), F.max(date_col).alias("gap_end"), F.count(F.lit(1)).alias("n_quotes")
    ).drop("island")


def seeded_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows picked by key hash: the same rows for any partitioning (a top-n, no sort)."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)


def sampled_entities(df: DataFrame, n: int, entity_cols: Sequence[str] = ENTITY, seed: int = 42) -> DataFrame:
    """All rows of ``n`` seeded entities."""
    chosen = seeded_sample(df.select(*entity_cols).distinct(), n, entity_cols, seed)
    return df.join(chosen, list(entity_cols), "left_semi")


def recent_slice(df: DataFrame, entities: DataFrame, days: int = 180, entity_cols: Sequence[str] = ENTITY, date_col: str = "date") -> DataFrame:
    """Last ``days`` of the chosen entities; the date bound is a scalar subquery."""
    last = df.agg(F.max(date_col)).scalar()
    return df.where(F.col(date_col) >= F.date_sub(last, days)).join(entities, list(entity_cols), "left_semi")


def entity_turnover(df: DataFrame, cut: str, entity_cols: Sequence[str] = ENTITY, date_col: str = "date") -> DataFrame:
    """Entities with sales only before, or only from, a cut date: one aggregate, no set operation."""
    late = F.col(date_col) >= F.lit(cut).cast("date")
    per = df.groupBy(*entity_cols).agg(F.bool_or(late).alias("late"), F.bool_or(~late).alias("early"))
    return per.where(F.col("late") != F.col("early")).select(
        *entity_cols, F.when(F.col("late"), "only_late").otherwise("only_early").alias("presence")
    )


def forecast_summary(preds: DataFrame, near_zero: float = 1e-12, by: Sequence[str] = ("family",), pred_col: str = "y_pred") -> DataFrame:
    """Near-zero rate, range, mean and exact median of predictions per group."""
    p = F.col(pred_col)
    base = preds.groupBy(*by).agg(
        F.avg((p <= near_zero).cast("int")).alias("near_zero_rate"), F.min(p).alias("pred_min"),
        F.avg(p).alias("pred_mean"), F.max(p).alias("pred_max"), F.count(F.lit(1)).alias("n"),
    )
    med = exact_quantiles(preds, pred_col, [0.5], by).select(*by, F.col("value").alias("pred_median"))
    return base.join(med, list(by))


def outlier_triage(df: DataFrame, event_date: str, share_days: int = 28, zero_share: float = 0.5) -> DataFrame:
    """Counts and actions for invalid, spike, regime and structural-zero rows.

    The entity window keeps the panel's distribution; all four counts come from one aggregate.
    """
    w = Window.partitionBy(*ENTITY)
    y = F.col("sales")
    off = F.datediff("date", F.lit(event_date).cast("date"))
    marked = df.select(
        (y < 0).alias("invalid"), (y > F.percentile(y, 0.99).over(w)).alias("spike"),
        off.between(0, share_days - 1).alias("regime"),
        (F.avg((y == 0).cast("int")).over(w) >= zero_share).alias("structural_zero"),
    )
    # Triage classes and the action taken for each.
    actions = {"invalid": "fail", "spike": "keep", "regime": "keep", "structural_zero": "keep"}
    counts = marked.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c)).alias(c) for c in actions])
    cells = F.array(*[
        F.struct(F.lit(c).alias("outlier_class"), F.col(c).alias("n_rows"),
                 (F.col(c) / F.col("total")).alias("share"), F.lit(a).alias("action"))
        for c, a in actions.items()
    ])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def ablation_deltas(steps: DataFrame, order_col: str = "step", score_col: str = "mean_rmsle") -> DataFrame:
    """Change of the score from one ablation step to the next (one row per step)."""
    return steps.withColumn("delta", F.col(score_col) - F.lag(score_col).over(Window.orderBy(order_col)))


def ablation_stability(fold_scores: DataFrame, need: int = 2, order_col: str = "step") -> DataFrame:
    """Folds improved by each step, and whether enough of them did."""
    before = F.lag("rmsle").over(Window.partitionBy("fold").orderBy(order_col))
    return (
        fold_scores.withColumn("_before", before).where(F.col("_before").isNotNull())
        .groupBy(order_col).agg(F.count_if(F.col("rmsle") < F.col("_before")).alias("folds_improved"))
        .withColumn("keep", F.col("folds_improved") >= need)
    )
