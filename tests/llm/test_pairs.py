import random
import re
import string

import numpy as np
import xxhash

from tidepanel.llm.components import connected_components
from tidepanel.llm.embeddings import embedding_links
from tidepanel.llm.simhash import linked_pairs, simhash_groups


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500), (7, 3), (7, 3)]
    want = roots(501, pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(None, 5)], "a long, b long")).collect()}
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_of_odd_rows(odd, nothing):
    rows = odd.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = roots(len(rows), pairs)
    least = {}
    for r, k in zip(rows, root):
        least[k] = min((x for x in (least.get(k), r.doc_id) if x is not None), default=None)
    want = sorted((str(r.doc_id), f"{f:016x}", str(least[k])) for r, f, k in zip(rows, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_groups(odd).collect()) == want
    assert simhash_groups(nothing).collect() == []


def test_every_close_pair_of_fingerprints_is_found_once(spark):
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = [(r.a, r.b) for r in linked_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base = rng.standard_normal(32)
        for k in range(6):
            rows.append((len(rows), (base + rng.standard_normal(32) * 0.04 * k).tolist(), i % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(20)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 0.0]]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (None, [5.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'clash' as n", "'clash' as cls", "'x' as a")
    got = embedding_links(df).collect()
    n = 380
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:n]])
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    by = {r.vec_id: r for r in got}
    have = np.array([by[i].n_links for i in range(n)])
    assert (have <= link.sum(1)).all() and have.sum() >= 0.97 * link.sum() and link.sum() > 1000
    root = roots(n, zip(*np.nonzero(link)))
    assert sum(by[i].component_id != root[i] for i in range(n)) <= 4
    assert all(by[i].kept == (by[i].component_id == i) for i in range(n))
    for i in [*range(1000, 1007), 2000]:
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[None].n_links == 0 and by[None].kept
    assert embedding_links(df.where("false")).collect() == []


def test_variants_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """64 variants come of each stored fingerprint: a file below the broadcast limit may be far above it by then."""
    rows = [((x * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63,) for x in range(2000)]
    spark.createDataFrame([*rows, (rows[0][0] ^ 5,)], "fp long").write.parquet(str(tmp_path / "fps"))
    pairs = linked_pairs(spark.read.parquet(str(tmp_path / "fps")))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [set(p) for p in pairs.collect()] == [{rows[0][0], rows[0][0] ^ 5}]
