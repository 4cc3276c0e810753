"""Prepare job: raw CSV to clean interim Parquet and fold bounds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.clean import clean_structural
from tidepanel.operators.explore import sales_tails
from tidepanel.operators.splits import expanding_folds
from tidepanel.sources.runs import save_folds
from tidepanel.sources.schemas import validate_test_schema, validate_train_schema
from tidepanel.sources.tables import INPUT_ORDER, load_raw_tables, read_interim, write_interim

# Sort columns of the interim files: rows of an entity lie together, in date order.
LAYOUT = {
    "train": ("store_nbr", "family", "date"), "test": ("store_nbr", "family", "date"),
    "transactions": ("store_nbr", "date"), "holidays_events": ("date",), "oil": ("date",),
}


def prepare(
    spark: SparkSession, raw_dir: str, interim_dir: str, splits_dir: str, cv: Mapping[str, int] | None = None,
) -> dict[str, DataFrame]:
    """Load, check, clean and write all tables, then the folds; returns summary tables."""
    raw = load_raw_tables(spark, raw_dir, ordered=("train", "oil"))
    validate_train_schema(raw["train"])
    validate_test_schema(raw["test"])
    # Dealt by ranges of its key before rows of a key meet, the largest table is moved once: its rows are grouped and
    # sorted where they are written.
    raw["train"] = raw["train"].repartitionByRange(*LAYOUT["train"])
    write_interim(clean_structural(raw, INPUT_ORDER), interim_dir, LAYOUT, placed=("train",))
    tables = read_interim(spark, interim_dir, raw)
    save_folds(expanding_folds(tables["train"], **(cv or {})), splits_dir)
    counts = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        counts = row if counts is None else counts.unionByName(row)
    return {"counts": counts, "tails": sales_tails(tables["train"])}
