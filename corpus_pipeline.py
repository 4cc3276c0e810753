"""Corpus pipeline: language ID, exact and near de-duplication, source mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.exact import exact_duplicates
from tidepanel.llm.language import keep_identified
from tidepanel.llm.mixing import mix_sources
from tidepanel.llm.packing import pack_documents
from tidepanel.llm.simhash import simhash_groups
from tidepanel.llm.workers import ship_package
from tidepanel.session import saved

KEYS = ["_id_key", "_text_key_1", "_text_key_2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the id and 128 bits of the text: decisions are joined back by these.

    Ids may be null or repeated. Rows that agree in all keys have the same id and text.
    """
    text = F.coalesce("text", F.lit(""))
    keys = [F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)]
    return docs.withColumns(dict(zip(KEYS, keys)))


def _taken(keyed: DataFrame, times: DataFrame) -> DataFrame:
    """Each document as often as ``times`` says for its keys; of rows that agree in them, one stands for all.

    The join is by shuffle at every size: the decisions grow with the documents.
    """
    joined = keyed.join(times.hint("merge"), KEYS)
    first = joined.withColumn("_nth", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*KEYS))).where("_nth = 1")
    repeated = first.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.drop(*KEYS, "_nth", "_times", "_copy")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; text that is null or has no letter goes, and nothing else if no language can be learnt."""
    ship_package(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the greatest id stays."""
    keyed = _keyed(docs)
    kept = exact_duplicates(keyed, carry=KEYS).where("kept")
    return _taken(keyed, kept.select(*KEYS, F.lit(1).alias("_times")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least id stays; null ids come last."""
    ship_package(spark)
    keyed = _keyed(docs)
    best = F.max(F.struct(F.bitwise_not("doc_id").alias("best"), *KEYS)).alias("kept")
    kept = simhash_groups(keyed, carry=KEYS).groupBy("component").agg(best)
    return _taken(keyed, kept.select("kept.*").select(*KEYS, F.lit(1).alias("_times")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    keyed = _keyed(docs)
    mixed = mix_sources(keyed, carry=KEYS).where("taken > 0")
    times = mixed.groupBy(*KEYS).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    return _taken(keyed, times)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

# Language models, SimHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
