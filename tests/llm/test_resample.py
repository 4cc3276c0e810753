"""Importance resampling against a plain version, CRC matrices against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from tidepanel.llm.resample import feature_crcs, hashed_features, ranked, resample

TARGET = ["alpha beta gamma 42 x", None, "don't über alpha", ""]


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [f.encode() for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, target, percent=25, least=20, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])
    s, t = count(r[1] for r in rows), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text, *_ in rows:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in (zlib.crc32(f) % buckets for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(order[:percent * len(order) // 100])}
    return sorted(([*r[:4], drawn.get(id(r))] for r in out), key=str)


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_whole_result_is_brute_force(spark, odd):
    got = resample(odd, frame(spark, TARGET), percent=60)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    want = brute(odd_rows(), TARGET, percent=60)
    got = sorted(map(list, got.collect()), key=str)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    # Rows that repeat an id and score may share out their ranks either way.
    assert sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    assert sum(r[4] is not None for r in got) > 3


def test_ranks_over_many_partitions(spark):
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "delta", "x"], k=i % 60)), None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert sorted(map(list, resample(docs, frame(spark, TARGET)).collect()), key=str) == brute(rows, TARGET)


def test_nothing(spark, odd, nothing):
    assert resample(nothing, frame(spark, TARGET)).collect() == []
    assert resample(odd, frame(spark, [])).count() == len(odd_rows())
    short = odd.where("length(text) < 20")
    assert resample(short, frame(spark, TARGET)).where("rank is not null").isEmpty()


def test_crc_of_every_length():
    rng = random.Random(5)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(1, 40), 40, 40, 300, 511, 512, 513, 5000]]
    first = np.array([rng.randrange(len(words)) for _ in range(3000)])
    second = np.array([rng.randrange(-1, len(words)) for _ in range(3000)])
    want = [zlib.crc32(words[a] + (b" " + words[b] if b >= 0 else b"")) for a, b in zip(first, second)]
    assert feature_crcs(words, first, second).tolist() == want


def test_blocks_cut_documents_anywhere():
    texts = ["a b c d e f g", "", None, "h", "i j", "k " * 30, "...", "l m n"]
    whole = [(n, sorted(b.tolist())) for n, b in hashed_features(iter(texts), 1000)]
    assert [n for n, _ in whole] == [7, 0, 0, 1, 2, 30, 0, 3]
    for size in range(2, 12):
        assert [(n, sorted(b.tolist())) for n, b in hashed_features(iter(texts), 1000, size)] == whole


def test_places(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    got = ranked(rows, [F.desc("a"), F.asc("id")]).orderBy("rank").collect()
    assert [(r["rank"], r["_rows"]) for r in got] == [(i + 1, 1000) for i in range(1000)]
    assert [(-r["a"], r["id"]) for r in got] == sorted((-(i % 7), i) for i in range(1000))
