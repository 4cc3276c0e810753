"""Session helpers: defaults for a panel workload and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.scheduler.mode": "FAIR",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidepanel")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(current)
        spark.conf.set("spark.tidepanel.scratch", current)
        return current
    return spark.conf.get("spark.tidepanel.scratch", current)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops plan growth."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: dict[tuple, str] = {}


def saved_once(
    spark: SparkSession, key: tuple, bucket_cols: Sequence[str], make: Callable[..., DataFrame],
    least_buckets: Callable[[], int] = lambda: 1, placed: bool = False,
) -> DataFrame:
    """A table that is made once per application and key, bucketed in the shared folder.

    It has as many buckets as the session has shuffle partitions, and ``least_buckets`` of them at least:
    a reader that makes many rows of one has to hold a bucket's worth of them in a task.

    Windows and joins on ``bucket_cols`` then start without a shuffle, and so do those on more columns:
    the session is told that rows which lie by a part of the join keys need not move.

    With ``placed``, ``make`` takes the number of buckets and deals its rows by ``bucket_cols`` itself.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    key = (spark.sparkContext.applicationId, *key)
    if key not in _stored:
        name = f"{key[1]}_{uuid.uuid4().hex}"
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least_buckets())
        made = make(buckets) if placed else make().repartition(buckets, *bucket_cols)
        made.write.bucketBy(buckets, *bucket_cols).option("path", scratch_path(spark, key[1])).saveAsTable(name)
        _stored[key] = name
    return spark.table(_stored[key])


def saved(df: DataFrame, label: str = "stage", options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet (with writer's ``options``) and read it back.

    For tables used several times: later readers keep column pruning and filter pushdown.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> None:
    """Drop this application's catalog tables made by ``saved_once``; their files stay with the scratch folder."""
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        spark.sql(f"DROP TABLE IF EXISTS {_stored.pop(key)}")
