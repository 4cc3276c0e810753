"""Exact de-duplication by deterministic block naming.

Texts are cut into fixed-size byte blocks. Distinct blocks are sorted and numbered; adjacent names
are paired and the distinct pairs numbered again, until every document has one name. Two documents
share (number of blocks, name) only if their bytes agree.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import saved


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def block_fingerprint(block: Column, round_: int) -> list[Column]:
    """128 bits of a block as two longs; another round gives other functions."""
    return [F.xxhash64(F.lit(2 * round_ + i), block) for i in range(2)]


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192,
    fingerprint: Callable[[Column, int], list[Column]] = block_fingerprint, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty. Of equal texts the row with the greatest id stays; of rows that
    repeat that id exactly one is kept. Null ids lose to any other id; a group with null ids only
    has a null ``keep_id`` and still keeps one row. No rows in, no rows out. Columns other than
    the two named, and small ones to hand through in ``carry``, are not read.

    The fingerprint only routes a block to its name: every run counts the different blocks behind
    each fingerprint, and draws other functions in the unlikely case that two share one.
    """
    text = F.encode(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "UTF-8")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), text.alias("_bytes"), *carry)
    last = F.greatest(F.ceil(F.octet_length("_bytes") / F.lit(block_bytes)).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    for round_ in range(8):
        blocks = rows.select(F.explode(cut).alias("block"))
        k1, k2 = fingerprint(F.col("block"), round_)
        blocks = blocks.select(k1.alias("k1"), k2.alias("k2"), "block").distinct()
        names = saved(_numbered(blocks, ["k1", "k2", "block"]).select("k1", "k2", "name"), "block-names")
        if names.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no collision-free fingerprint in 8 rounds")
    keys = F.transform(cut, lambda b: F.struct(*[c.alias(n) for c, n in zip(fingerprint(b, round_), ("k1", "k2"), strict=True)]))
    base = saved(rows.select("_row", "_id", F.sha2("_bytes", 256).alias("sha"), keys.alias("keys"), *carry), "blocks")
    named = (
        base.select("_row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
        .select("_row", "n", "pos", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"))
        .join(names, ["k1", "k2"]).select("_row", "n", "pos", "name")
    )
    identity = _pair_up(saved(named, "named-blocks"))
    rows = saved(base.select("_row", "_id", "sha", *carry).join(identity, "_row").select("_row", "_id", "sha", "n", "name", *carry), "identities")
    # Written first: a join whose side is still being aggregated can't split a large group.
    groups = saved(rows.groupBy("n", "name").agg(F.max(F.struct("_id", "_row")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["n", "name"]).select(
        F.col("_id").alias(id_col), F.col("keep._id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("keep._row")).alias("kept"), F.col("sha").alias("text_sha256"), *carry,
    )


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names for distinct rows: dealt by content, sorted in each partition and counted."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _pair_up(named: DataFrame) -> DataFrame:
    """Name adjacent pairs level by level; ``_row``, ``n`` (blocks of the document), ``name``."""
    most = named.agg(F.max("n")).first()[0] or 1
    done = named.where("n = 1").select("_row", "n", "name")
    level = named.where("n > 1").select("_row", "n", "pos", "name")
    width = F.col("n")
    while most > 1:
        pos = F.col("pos")
        pairs = level.groupBy("_row", "n", F.shiftright("pos", 1).alias("half")).agg(
            F.max(F.when(pos % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(pos % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = saved(pairs.select("_row", "n", F.col("half").alias("pos"), "l", "r"), "pairs")
        names = saved(_numbered(pairs.select("l", "r").distinct(), ["l", "r"]), "pair-names")
        level = pairs.join(names, ["l", "r"]).select("_row", "n", "pos", "name")
        width, most = F.ceil(width / 2), (most + 1) // 2
        if most > 1:
            level = saved(level, "named-pairs")
        done = done.unionByName(level.where(width == 1).select("_row", "n", "name"))
        level = level.where(width > 1)
    return done
