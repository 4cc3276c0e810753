"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells of width
``width``; ``projections`` cells together are a bucket of one table. Unit vectors of cosine c lie
sqrt(2 - 2c) apart, and meet in a table with the chance that no cut falls between them. With the
defaults a pair at cosine 0.98 meets in at least one of the tables in 99 of 100 cases, a closer one
more often; unrelated vectors meet in a table about twice in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.components import connected_components
from tidepanel.session import saved


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _rows(column: pa.ListArray) -> np.ndarray:
    """Equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _buckets(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket name per vector and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    cells = unit @ rng.standard_normal((unit.shape[1], tables * projections)) / width + rng.random(tables * projections)
    cells = np.floor(cells).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    mix = rng.integers(1, 1 << 63, projections, dtype=np.uint64) | np.uint64(1)
    names = (cells * mix).sum(axis=2, dtype=np.uint64)
    names = (names ^ names >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return names.view(np.int64)


def embedding_links(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tables: int = 24, projections: int = 10, width: float = 1.0, seed: int = 0,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Two rows link if their labels are equal and not null, their vectors have as many components and
    the cosine in double precision is at least ``cosine``. A vector that is null, empty, zero or has
    null or non-finite components links with nothing. Equal vectors of a label are one class and
    never expanded into pairs: each row links with the others of its class and with all rows of
    linked classes. ``component_id`` is the least id reachable; ``kept`` marks the rows with that
    id. A row with a null id counts as a vector; alone it has a null component and is kept.
    No rows in, no rows out; other columns are not read.
    """
    values = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(good, values).alias("vec"))
    classes = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                names = _buckets(_unit(_rows(part.column(2))), tables, projections, width, seed)
                n = part.num_rows
                again = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(again), part.column(1).take(again), pa.array(np.full(n * tables, size, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(names.reshape(-1))],
                    ["cls", "label", "size", "tab", "bucket"],
                )

    label = classes.schema["label"].dataType.simpleString()
    index = saved(classes.select("cls", "label", "vec").mapInArrow(sign, f"cls long, label {label}, size int, tab int, bucket long"), "buckets")
    key = ["label", "size", "tab", "bucket"]
    left, right = index.withColumnRenamed("cls", "a"), index.withColumnRenamed("cls", "b")
    found = saved(left.join(right, key).where("a < b").select("a", "b").distinct(), "candidates")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                dots = np.einsum("ij,ij->i", _unit(_rows(part.column(2))), _unit(_rows(part.column(3))))
                yield part.select(["a", "b"]).filter(pa.array(dots >= cosine))

    with_vectors = found.join(classes.select(F.col("cls").alias("a"), F.col("vec").alias("va")), "a").join(classes.select(F.col("cls").alias("b"), F.col("vec").alias("vb")), "b")
    links = saved(with_vectors.select("a", "b", "va", "vb").mapInArrow(check, "a long, b long"), "vector-links")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("cls").alias("b"), "n")
    degree = ends.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cls")
    parts = connected_components(links).withColumnRenamed("node", "cls")
    named = saved(classes.select("cls", "label", "vec", "least", "n").join(degree, "cls", "left").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "vector-members")
    least = saved(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    table = saved(named.join(least, "component").select("label", "vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id"), "vector-table")
    return rows.join(table, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("links").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
