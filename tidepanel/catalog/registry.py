"""Registry of queries with their oracle SQL, and the shared SQL tables of the oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.sources.warehouse import EVENT, TEST_DAYS, Warehouse

# SQL for the last day of the training panel.
TRAIN_END = f"(SELECT last_day_ - {TEST_DAYS} FROM bounds)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Oracle tables in DuckDB SQL; a query pulls in the ones its text names.
CTES: dict[str, str] = {
    "bounds": "SELECT CAST(MIN(l_shipdate) AS DATE) AS first_day_, CAST(MAX(l_shipdate) AS DATE) AS last_day_ FROM lineitem",
    "cal": "SELECT CAST(unnest(generate_series(CAST(first_day_ AS TIMESTAMP), CAST(last_day_ AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM bounds",
    "stores": "SELECT CAST(s_suppkey AS INT) AS store_nbr, n_name AS city, r_name AS state, "
              "substr('ABCDE', CAST(n_nationkey % 5 AS INT) + 1, 1) AS type, CAST(n_nationkey % 7 AS INT) AS cluster "
              "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "sparse": "SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS INT) AS store_nbr, p_type AS family, "
              "SUM(l_quantity) AS sales, CAST(SUM(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS INT) AS onpromotion "
              "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
    "fam": "SELECT p_type AS family, row_number() OVER (ORDER BY p_type) - 1 AS f FROM (SELECT DISTINCT p_type FROM part)",
    "panel": "SELECT c.date, e.store_nbr, e.family, COALESCE(s.sales, 0.0::DOUBLE) AS sales, COALESCE(s.onpromotion, 0) AS onpromotion "
             "FROM (SELECT DISTINCT store_nbr, family FROM sparse) e CROSS JOIN cal c LEFT JOIN sparse s "
             "ON s.date = c.date AND s.store_nbr = e.store_nbr AND s.family = e.family",
    "panel_id": "SELECT (CAST(store_nbr AS BIGINT) * (SELECT last_day_ - first_day_ + 1 FROM bounds) + (date - (SELECT first_day_ FROM bounds))) "
                "* (SELECT COUNT(*) FROM fam) + f AS id, panel.* FROM panel JOIN fam USING (family)",
    "train": f"SELECT * FROM panel WHERE date <= {TRAIN_END}",
    "train_id": f"SELECT * FROM panel_id WHERE date <= {TRAIN_END}",
    "test": f"SELECT id, date, store_nbr, family, onpromotion FROM panel_id WHERE date > {TRAIN_END}",
    "oil": "SELECT c.date, CASE WHEN day(c.date) % 11 <> 0 THEN ROUND(o.p / 1000, 2) END AS dcoilwtico "
           "FROM (SELECT * FROM cal WHERE isodow(date) < 6) c LEFT JOIN "
           "(SELECT CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) AS p FROM orders GROUP BY 1) o ON o.date = c.date",
    "tx": "SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS INT) AS store_nbr, CAST(COUNT(*) AS INT) AS transactions "
          f"FROM lineitem WHERE CAST(l_shipdate AS DATE) <= {TRAIN_END} GROUP BY 1, 2",
    "busy": "SELECT CAST(o_orderdate AS DATE) AS date, n_name, r_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey "
            "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3",
    "hol": "SELECT date, CASE n % 5 WHEN 0 THEN 'Holiday' WHEN 1 THEN 'Transfer' WHEN 2 THEN 'Bridge' WHEN 3 THEN 'Work Day' ELSE 'Additional' END AS type, "
           "locale, locale_name, n || ' orders' AS description, n % 4 = 0 AS transferred FROM (SELECT *, row_number() OVER "
           "(PARTITION BY locale, locale_name, date_trunc('month', date) ORDER BY n DESC, date DESC) AS nth FROM ("
           "SELECT 'National' AS locale, 'Country' AS locale_name, date, CAST(SUM(n) AS BIGINT) AS n FROM busy GROUP BY date UNION ALL "
           "SELECT 'Regional', r_name, date, CAST(SUM(n) AS BIGINT) FROM busy GROUP BY r_name, date UNION ALL SELECT 'Local', n_name, date, n FROM busy)) WHERE nth = 1",
    "grid": "SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS r FROM (SELECT DISTINCT date FROM train)",
    "folds": "SELECT CAST(2 - b AS INT) AS fold, (SELECT date FROM grid WHERE r = 15 * b + 15) AS train_end, "
             "(SELECT date FROM grid WHERE r = 15 * b + 14) AS val_start, (SELECT date FROM grid WHERE r = 15 * b) AS val_end "
             "FROM (VALUES (0), (1), (2)) t(b)",
    "valrows": "SELECT p.*, f.fold, f.train_end, f.val_start FROM train p JOIN folds f ON p.date BETWEEN f.val_start AND f.val_end",
    "lastv": "SELECT f.fold, t.store_nbr, t.family, arg_max(t.sales, t.date) AS lv FROM train t JOIN folds f ON t.date <= f.train_end GROUP BY 1, 2, 3",
    "oofw": "SELECT v.store_nbr, v.family, v.date, v.fold, v.sales AS y_true, COALESCE(l.lv, 0) AS last_value, "
            "COALESCE(a.sales, l.lv, 0) AS seasonal_naive_7, COALESCE(b.sales, l.lv, 0) AS seasonal_naive_14 FROM valrows v "
            "LEFT JOIN lastv l ON l.fold = v.fold AND l.store_nbr = v.store_nbr AND l.family = v.family "
            "LEFT JOIN train a ON a.store_nbr = v.store_nbr AND a.family = v.family AND a.date = v.date - 7 * GREATEST(1, CAST(CEIL((v.date - v.train_end) / 7.0) AS INT)) "
            "LEFT JOIN train b ON b.store_nbr = v.store_nbr AND b.family = v.family AND b.date = v.date - 14 * GREATEST(1, CAST(CEIL((v.date - v.train_end) / 14.0) AS INT))",
    "oof": "SELECT store_nbr, family, date, fold, y_true, seasonal_naive_7 AS y_pred FROM oofw",
    "oofl": "UNPIVOT oofw ON last_value, seasonal_naive_7, seasonal_naive_14 INTO NAME method VALUE y_pred",
    "daily": "SELECT date, SUM(sales) AS total_sales FROM train GROUP BY 1",
    "sliced": "SELECT o.*, CAST(o.date - f.val_start AS INT) + 1 AS horizon, "
              "CAST(day(o.date) = 15 OR o.date = last_day(o.date) AS INT) AS is_payday, CAST(o.y_true <= 0 AS INT) AS is_zero, "
              "s.city, s.state, s.type AS store_type, s.cluster FROM oof o JOIN folds f USING (fold) LEFT JOIN stores s USING (store_nbr)",
}

D2 = "POW(LN(1 + y_pred) - LN(1 + y_true), 2)"
SCORES = (f"COUNT(*) AS n, SQRT(AVG({D2})) AS rmsle, AVG(ABS(LN(1 + y_pred) - LN(1 + y_true))) AS mae_log1p, "
          "AVG(LN(1 + y_pred) - LN(1 + y_true)) AS bias_log1p")
SCORE_COLS = "rmsle mae_log1p bias_log1p"


def oracle(body: str, doubles: str = "", **local: str) -> str:
    """Full SQL: needed tables as CTEs, the body, and doubles rounded to six places."""
    known = {**CTES, **local}
    seen: dict[str, None] = {}

    def need(text: str, above: tuple[str, ...] = ()) -> None:
        for name in known:
            if name not in seen and name not in above and re.search(rf"\b{name}\b", text):
                need(known[name], (*above, name))
                seen.setdefault(name)

    need(body)
    head = ", ".join(f"{n} AS ({known[n]})" for n in seen)
    recursive = "RECURSIVE " if any("UNION ALL" in v for v in local.values()) else ""
    prefix = f"WITH {recursive}{head} " if head else ""
    if doubles:
        fixed = ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in doubles.split())
        return f"{prefix}SELECT * REPLACE ({fixed}) FROM ({body})"
    return prefix + body


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places (minus zero to zero), as in the oracle.

    They are scaled, rounded half away from zero and scaled back, as the oracle's engine does it: Spark's
    own rounding goes by decimals and costs more than filling in a day. It is left to numbers too great to scale.
    """
    def rounded(col):
        scaled = F.signum(col) * F.floor(F.abs(col) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
        return F.when(col == F.rint(col), col).when(F.abs(col) < F.lit(1e9), scaled).otherwise(F.round(col, 6)) + F.lit(0.0)

    return df.select(
        *[
            rounded(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def query(name: str, sql: str | None = None):
    """Register ``fn(warehouse) -> DataFrame`` with its oracle, if it has one."""

    def wrap(fn: Callable[[Warehouse], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, path: tidy(fn(Warehouse(spark, path)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
