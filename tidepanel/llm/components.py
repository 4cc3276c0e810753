"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.session import saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node that has an edge to another node: ``node``, ``component`` (its smallest node).

    Edges may repeat, point either way or be loops; rows with a null end are ignored. An empty
    input gives an empty result. Minimums combine map-side and the joins back are plain equality
    joins, so a hub with very many edges is split by adaptive skew join. Every round is written to
    the shared folder; only a row count and a checksum reach the driver.
    """
    cur = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    cur = saved(cur, "edges")
    mark = _checksum(cur)
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select("v", F.col("m")).toDF("u", "v")
        cur = saved(small.unionByName(low.toDF("u", "v")).distinct(), "small-star")
        before, mark = mark, _checksum(cur)
        if mark == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
