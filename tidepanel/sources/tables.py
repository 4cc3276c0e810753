"""Raw CSV catalog, interim Parquet tables, side tables and numeric down-casts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.scalars import parse_date
from tidepanel.sources.schemas import RAW_SCHEMAS

# Side tables each feature group needs.
GROUP_TABLES: dict[str, tuple[str, ...]] = {
    "oil": ("oil",),
    "holiday": ("holidays_events", "stores"),
    "store_meta": ("stores",),
    "transactions": ("transactions",),
}


def missing_is_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


INPUT_ORDER = "_input_order"


def with_input_order(scan: DataFrame) -> DataFrame:
    """A file scan with ``_input_order``: file, first byte of the block, then the row's place in the task.

    A task reads its blocks one after the other and each from front to back, so the column orders
    rows as the files hold them. Apply it to the scan itself.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    return scan.select("*", place.alias(INPUT_ORDER))


def load_raw_tables(spark: SparkSession, raw_dir: str, ordered: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every raw table as a lazy, schema-typed CSV scan; a missing file raises by name.

    Tables named in ``ordered`` carry their input order.
    """
    out = {}
    for name, schema in RAW_SCHEMAS.items():
        path = f"{raw_dir.rstrip('/')}/{name}.csv"
        try:
            scan = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
            out[name] = missing_is_null(with_input_order(scan) if name in ordered else scan)
        except AnalysisException as err:
            raise FileNotFoundError(f"raw table {name!r} not found at {path}") from err
    return out


def write_raw_tables(tables: Mapping[str, DataFrame], raw_dir: str) -> None:
    """CSV sink, one folder per table; many compressed files, so readers still run in parallel."""
    for name, df in tables.items():
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMAS[name]]
        df.select(*cols).write.mode("errorifexists").options(header=True, compression="gzip").csv(
            f"{raw_dir.rstrip('/')}/{name}.csv"
        )


def parse_dates(df: DataFrame, date_col: str = "date", strict: bool = True) -> DataFrame:
    """Text or timestamp to date; bad text raises in strict mode, else turns NULL."""
    return df.withColumn(date_col, parse_date(date_col, strict=strict))


def write_interim(
    tables: Mapping[str, DataFrame],
    interim_dir: str,
    layout: Mapping[str, Sequence[str]] | None = None,
    placed: Sequence[str] = (),
) -> None:
    """Parquet sink, one folder per table.

    ``layout`` names sort columns per table: rows are clustered by the first and sorted
    inside each file, so row-group statistics prune entity and date predicates.  Tables in
    ``placed`` lie together by the first column already; they are sorted where they lie.
    """
    layout = layout or {}
    for name, df in tables.items():
        keys = [c for c in layout.get(name, ()) if c in df.columns]
        if keys:
            df = (df if name in placed else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
        df.write.mode("overwrite").parquet(f"{interim_dir.rstrip('/')}/{name}.parquet")


def write_bucketed(
    df: DataFrame, table: str, path: str, *, keys: Sequence[str], sort: Sequence[str], buckets: int
) -> DataFrame:
    """Catalog table bucketed by entity and sorted by date.

    Lag windows, recursion state and entity joins on the table then start without a shuffle.
    Rows are hashed to their bucket first, so each bucket is one file.
    """
    (
        df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *keys).sortBy(*keys, *sort).saveAsTable(table)
    )
    return df.sparkSession.table(table)


def read_interim(spark: SparkSession, interim_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{interim_dir.rstrip('/')}/{n}.parquet") for n in names}


def load_feature_extras(
    spark: SparkSession, groups: Sequence[str], interim_dir: str
) -> dict[str, DataFrame]:
    """Side tables of the requested groups only; other files are never opened."""
    names = dict.fromkeys(t for g in groups for t in GROUP_TABLES.get(g, ()))
    return read_interim(spark, interim_dir, names)


def downcast_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Doubles to float, longs to int where asked for smaller tables; ``keep`` stays wide.

    Casting a long that does not fit raises under ANSI mode rather than wrapping.
    """
    cols = []
    for field in df.schema:
        col = F.col(field.name)
        if field.name not in keep:
            if isinstance(field.dataType, T.DoubleType):
                col = col.cast("float")
            elif isinstance(field.dataType, T.LongType):
                col = col.cast("int")
        cols.append(col.alias(field.name))
    return df.select(*cols)
