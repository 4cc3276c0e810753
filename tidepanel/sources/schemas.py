"""Explicit schemas and column contracts of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType(),
}


def _struct(columns: str) -> T.StructType:
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Table names, columns and types of the competition data set.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "train": _struct(
        "id bigint, date date, store_nbr int, family string, sales double, onpromotion int"
    ),
    "test": _struct("id bigint, date date, store_nbr int, family string, onpromotion int"),
    "stores": _struct("store_nbr int, city string, state string, type string, cluster int"),
    "oil": _struct("date date, dcoilwtico double"),
    "holidays_events": _struct(
        "date date, type string, locale string, locale_name string, "
        "description string, transferred boolean"
    ),
    "transactions": _struct("date date, store_nbr int, transactions int"),
    "sample_submission": _struct("id bigint, sales double"),
}
TRAIN_REQUIRED = ("id", "date", "store_nbr", "family", "sales", "onpromotion")
TEST_REQUIRED = ("id", "date", "store_nbr", "family", "onpromotion")
OOF_REQUIRED = ("store_nbr", "family", "date", "fold", "y_true", "y_pred")
FOLD_SCHEMA = _struct("fold int, train_end date, val_start date, val_end date")

ENTITY = ("store_nbr", "family")
DATE = "date"
TARGET = "sales"


def require_columns(df: DataFrame, required, label: str) -> DataFrame:
    """Plan-time contract: extra columns pass, missing ones raise."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label} is missing required columns {missing}; has {df.columns}")
    return df


def validate_train_schema(df: DataFrame) -> DataFrame:
    return require_columns(df, TRAIN_REQUIRED, "train")


def validate_test_schema(df: DataFrame) -> DataFrame:
    return require_columns(df, TEST_REQUIRED, "test")
