import hashlib
import string
from collections import Counter

from pyspark.sql import functions as F

from tidepanel.llm.exact import exact_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def check(rows, got):
    texts = [(i, (t or "").translate(LOWER)) for i, t in rows]
    want, stay = Counter(), {}
    for i, t in texts:
        stay[t] = max(stay.get(t, -1), -1 if i is None else i)
    size = Counter(t for _, t in texts)
    for i, t in texts:
        want[i, None if stay[t] < 0 else stay[t], size[t], hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({hashlib.sha256(t.encode()).hexdigest() for t in size})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows_in_many_small_blocks(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(rows, exact_duplicates(odd, block_bytes=64).collect())


def test_shared_fingerprints_never_join_different_blocks(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]

    def weak(block, round_):
        return [F.octet_length(block).cast("long"), F.lit(0).cast("long")] if not round_ else [F.xxhash64(block), F.lit(0).cast("long")]

    check(rows, exact_duplicates(odd, fingerprint=weak).collect())


def test_no_rows(nothing):
    assert exact_duplicates(nothing).collect() == []
