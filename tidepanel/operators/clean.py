"""Structural cleaning: de-duplication, causal fill, guards and gap filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.sources.schemas import ENTITY, require_columns


def keep_one(df: DataFrame, keys: Sequence[str], order_by: str | None = None, keep: str = "last") -> DataFrame:
    """One row per key, the last or first in ``order_by``.

    Spark has no row order, so the order is a column; without one, the greatest (or least)
    remaining values win, which is deterministic too.  Done as an aggregate: copies of a hot
    key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if len(rest) == 1 and keep == "last":
        # The greatest of one column needs no struct, and a number is then grouped without a sort.
        return df.groupBy(*keys).agg(F.max(rest[0]).alias(rest[0])).select(*df.columns)
    others = [c for c in rest if c != order_by]
    value = F.struct(*([order_by] if order_by else []), *others)
    pick = {"last": F.max, "first": F.min}[keep](value)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def flag_invalid_sales(df: DataFrame, target_col: str = "sales") -> DataFrame:
    """Row-aligned flag of negative targets; nothing is dropped."""
    return df.withColumn("is_invalid", F.coalesce(F.col(target_col) < 0, F.lit(False)))


def assert_nonnegative(df: DataFrame, target_col: str = "sales") -> DataFrame:
    """In-plan guard: the job that uses the table fails on the first negative target."""
    bad = F.concat(F.lit(f"negative {target_col}: "), F.col(target_col).cast("string"))
    return df.withColumn(
        target_col, F.when(F.col(target_col) < 0, F.raise_error(bad).cast("double")).otherwise(
            F.col(target_col))
    )


def clean_oil(
    oil: DataFrame, date_col: str = "date", oil_col: str = "dcoilwtico", order_by: str | None = None
) -> DataFrame:
    """One price per date, forward-filled from the past; leading NULLs stay.

    The unpartitioned window runs after the per-date aggregate: one row per quoted day.
    """
    daily = keep_one(oil, [date_col], order_by)
    past = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn(oil_col, F.last(oil_col, ignorenulls=True).over(past))


def clean_train(
    train: DataFrame, entity_cols: Sequence[str] = ENTITY, date_col: str = "date",
    target_col: str = "sales", order_by: str | None = None,
) -> DataFrame:
    unique = keep_one(train, [*entity_cols, date_col], order_by)
    return assert_nonnegative(unique, target_col)


def clean_holidays(holidays: DataFrame) -> DataFrame:
    require_columns(holidays, ["date", "transferred"], "holidays_events")
    return holidays.withColumn("transferred", F.col("transferred").cast("boolean"))


def clean_structural(tables: Mapping[str, DataFrame], order_by: str | None = None) -> dict[str, DataFrame]:
    """All seven tables; row order is left to the sink.

    Of rows with the same key the last in ``order_by`` stays, in tables that have that column; it
    is dropped afterwards.
    """

    def order_of(df: DataFrame) -> str | None:
        return order_by if order_by in df.columns else None

    steps = {
        "train": lambda df: clean_train(df, order_by=order_of(df)),
        "oil": lambda df: clean_oil(df, order_by=order_of(df)),
        "holidays_events": clean_holidays,
    }
    made = {name: steps[name](df) if name in steps else df for name, df in tables.items()}
    return {name: df.drop(order_by) if order_by else df for name, df in made.items()}


def densify(
    sparse: DataFrame,
    *,
    entity_cols: Sequence[str],
    date_col: str,
    start: str,
    end: str,
    fill: Mapping[str, object],
    partitions: int | None = None,
    placed: bool = False,
    within: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Fill missing days of each entity between ``start`` and ``end``.

    Each observed row expands to the days before the entity's next one; the first row also
    reaches back to ``start``.  One window per entity and no calendar join; the output keeps
    the entity distribution, so lag windows downstream need no further shuffle.  Input must
    be unique on entity and date and lie inside the range.

    Rows grow here, so the number of partitions is fixed up front (default: the session's
    shuffle partitions); sized by the small input, AQE would merge them into too few tasks.
    With ``placed`` the rows stay where they are: they lie by entity, or part of it, already.
    ``within`` makes only the days between its ends (each of them, None for open), the same as a
    filter on the filled days would leave; every entity still has all of those days.
    """
    if not placed:
        n = partitions or int(sparse.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sparse = sparse.repartition(n, *entity_cols)
    w = Window.partitionBy(*entity_cols).orderBy(date_col)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    until = F.coalesce(F.date_sub(F.lead(date_col).over(w), 1), last)
    since = F.when(F.lag(date_col).over(w).isNull(), first).otherwise(F.col(date_col))
    # Day numbers: a sequence of integers costs a small part of one of dates.
    since, until = F.unix_date(since), F.unix_date(until)
    low, high = (F.unix_date(F.lit(d).cast("date")) if d else None for d in within)
    if low is not None:
        since = F.greatest(since, low)
    if high is not None:
        until = F.least(until, high)
    spans = sparse.withColumns({"_since": since, "_until": until}).where(F.col("_since") <= F.col("_until"))
    exploded = spans.withColumn("_days", F.sequence("_since", "_until")).withColumn("_day", F.explode("_days"))
    exploded = exploded.withColumn("_day", F.date_from_unix_date("_day"))
    observed = F.col("_day") == F.col(date_col)
    return exploded.select(
        *[
            F.col("_day").alias(c)
            if c == date_col
            else F.when(observed, F.col(c)).otherwise(F.lit(fill[c])).alias(c)
            if c in fill
            else F.col(c)
            for c in sparse.columns
        ]
    )
