"""Registered queries against their SQL on the smallest data set.

A spread of queries runs by default; set ``TIDEPANEL_ALL_ORACLES=1`` for all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
SPREAD = [
    "a8_fold_manifest_join", "a16_trial_resume", "b3_calendar_features", "b16_ordered_statistics", "b21_leakage_audit", "c2_holiday_flags",
    "c8_fill_from_oof", "c13_seasonal_lookup", "d14_column_profile", "n7_battery_column_model", "p2_submission_order_and_sign", "l16_blend_job",
    "c10_align_oofs", "d4_fold_summary", "d7_segment_table", "d13_sales_tails", "d22_event_windows", "e3_shifted_rolling",
    "g4_id_set_difference", "k1_expanding_folds", "k3_inner_last_block", "l2_seasonal_naive", "l5_fold_matrix",
    "l6_recursive_forecast", "m8_best_trial", "n1_relative_noise", "n3_clip_spikes", "o8_weekday_boxes", "p1_submission_checks",
]
ORACLES = entry_point.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(rows):
    def cell(v):
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TIDEPANEL_ALL_ORACLES") else SPREAD)
def test_query_matches_oracle(spark, duck, name):
    got = entry_point.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    rel = duck.sql(ORACLES[name])
    assert cols == sorted(rel.columns)
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert canonical(got.select(*cols).collect()) == canonical(want)


def test_every_query_is_callable_and_oracles_have_queries():
    queries = entry_point.queries()
    assert set(ORACLES) <= set(queries) and all(callable(f) for f in queries.values())


def test_panel_holds_every_fact_and_ids_are_unique(spark, duck):
    from tidepanel.sources.warehouse import Warehouse

    w = Warehouse(spark, DATA)
    total, n, ids = w.with_id(w.panel()).selectExpr("sum(sales)", "count(*)", "count(distinct id)").first()
    assert total == duck.sql("select sum(l_quantity) from lineitem").fetchall()[0][0] and n == ids
    assert "Exchange" not in w.panel()._jdf.queryExecution().executedPlan().toString()


def test_panel_rows_are_grouped_where_they_are_written(spark):
    from tidepanel.sources.warehouse import Warehouse

    plan = Warehouse(spark, DATA).panel_sparse(5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(store_nbr" in plan


def test_upsert_fills_the_panel_once(spark):
    plan = entry_point.queries()["a13_keyed_upsert"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "LeftAnti" in plan


@pytest.mark.parametrize("name", ["c8_fill_from_oof", "c13_seasonal_lookup", "l5_fold_matrix"])
def test_rows_are_not_summed_up(spark, name):
    assert {"store_nbr", "family", "date"} <= set(entry_point.queries()[name](spark, DATA).columns)
