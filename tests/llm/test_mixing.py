import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import mixing
from tidepanel.llm.queries import QUERIES
from tidepanel.llm.mixing import capped_targets, min_cost_flow, mix_sources


def water_fill(sizes, weights, total):
    """The rule in words: share by weight, stop at the cap, share the excess again."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes)]
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        give = {i: left * weights[i] / w for i in open_}
        left = 0.0
        for i in list(open_):
            target[i] += give[i]
            if target[i] >= 3 * sizes[i]:
                left += target[i] - 3 * sizes[i]
                target[i] = 3.0 * sizes[i]
                open_.remove(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 7], [0, 50, 0, 3], [1000, 1, 1, 1, 1], [5]])
def test_targets_are_shares_with_caps(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert capped_targets(sizes, weights, sum(sizes)) == pytest.approx(water_fill(sizes, weights, sum(sizes)))


def test_flow_repeats_only_where_it_must():
    # Pattern 0 serves either source, 1 only the second; the first source must lean on pattern 0.
    routes = min_cost_flow([100, 50], [120, 60], [[0, 1], [1]])
    assert sum(routes[0]) + sum(routes[1]) == 180
    assert routes[0][0] == 120 and routes[0][1] + routes[1][0] == 60
    assert min_cost_flow([10], [100], [[0]]) == [[30]]
    assert min_cost_flow([], [], []) == []


def test_mix_of_odd_rows(spark, odd, nothing):
    many = odd.select("doc_id", "text", "source", F.lit("x").alias("rest")).unionByName(
        spark.range(100, 700).select(
            F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.pmod(F.col("id") * 7, F.lit(90)).cast("int")).alias("text"),
            F.element_at(F.array(*map(F.lit, "abcc")), F.pmod("id", F.lit(4)).cast("int") + 1).alias("source"), F.lit("x").alias("rest"))
    )
    got = mix_sources(many).collect()
    rows = many.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=key) == sorted(((r.doc_id, words(r.text), r.source) for r in rows), key=key)
    held, taken, target = Counter(), Counter(), {}
    biggest = defaultdict(int)
    for r in got:
        held[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        biggest[r.source] = max(biggest[r.source], r.size)
    names = sorted(held, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in names] == pytest.approx(water_fill([held[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(held.values())))
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in names)
    again = mix_sources(many.repartition(7)).collect()
    flat = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rs)
    assert flat(got) == flat(again)
    assert mix_sources(nothing).collect() == []


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 40 else ["a", "b"] if i < 50 else ["b"]) for i in range(60)], "doc_id long, text string, lists array<string>")
    got = mix_sources(df, sources=lambda: F.col("lists"), weights=(1, 1)).collect()
    assert {r.source_size for r in got if r.source == ["a"]} == {500} and {r.source_size for r in got if r.source == ["b"]} == {200}
    assert sum(r.taken for r in got) == 600
    # b may take 300 of the words of 20 documents, a the rest; no document more than three times.
    assert max(r.taken for r in got) <= 30 and sum(r.taken for r in got if r.source != ["a"]) >= 300


def seeded(i):
    return int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("long", [60_000, 40_000])
def test_a_document_that_does_not_fit_is_passed_over(spark, tmp_path, long):
    # Sources of equal size weigh 5, 2 and 1; the last holds one long document, third in the order, and 180 short ones.
    ids = sorted(range(181), key=seeded)
    size = long + 18_000
    rows = [(i, "w " * (long if i == ids[2] else 100), "c") for i in ids] + [(1000 + k, "w " * (size // 10), s) for s in "ab" for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sum(r.taken for r in mix_sources(docs).collect() if r.source == "c") == 18_000
    folder = tmp_path / "data"
    docs.write.parquet(str(folder / "documents.parquet"))
    assert sum(r.taken for r in QUERIES["op2_source_mix"](spark, str(folder)).collect() if r.source == "c") == 18_000


def test_alternating_sizes_end_in_few_rounds(spark, monkeypatch):
    # In seeded order the sizes are 1, 60, 1, 59, ...: each document of one word leaves one word less.
    ids = sorted(range(120), key=seeded)
    sizes = [v for k in range(60) for v in (1, 60 - k)]
    rows = [(i, "w " * n, "c") for i, n in zip(ids, sizes)] + [(1000 + k, "w " * 189, s) for s in "ab" for k in range(10)]
    calls, cuts = [], mixing._cuts
    monkeypatch.setattr(mixing, "_cuts", lambda *a: calls.append(1) or cuts(*a))
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r.size for r in got if r.source == "c") == 1890
    rest = int(next(r.target for r in got if r.source == "c") + 0.5)
    assert abs(sum(r.taken for r in got if r.source == "c") - rest) <= 1 and len(calls) <= 9


def test_extra_copies_are_a_prefix_then_classes_of_size(spark):
    rng = random.Random(3)
    rows = [(i, "w " * int(rng.paretovariate(0.6)) if rng.random() < 0.9 else "", "abc"[i % 3]) for i in range(90)]
    rows = [(i, t[:8_000], s) for i, t, s in rows]
    got = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()}
    for source in "abc":
        mine = [got[i] for i in sorted((i for i, _, s in rows if s == source), key=seeded)]
        full, left = divmod(int(mine[0].target + 0.5), mine[0].source_size)
        want, fits = dict.fromkeys((r.doc_id for r in mine), False), True
        for r in mine:
            fits = fits and r.size <= left
            if r.size and fits:
                want[r.doc_id] = True
                left -= r.size
        for j in range(20, -1, -1):
            for r in mine:
                if want[r.doc_id] or r.size.bit_length() - 1 != j:
                    continue
                if r.size > left:
                    break
                want[r.doc_id] = True
                left -= r.size
        near = [r for r in mine if r.size and not want[r.doc_id] and abs(left - r.size) < left]
        if near:
            want[min(near, key=lambda r: abs(left - r.size)).doc_id] = True
        assert {r.doc_id: r.taken for r in mine} == {r.doc_id: r.size * (full + want[r.doc_id]) for r in mine}
