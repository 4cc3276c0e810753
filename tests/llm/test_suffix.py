import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import suffix


def brute(texts, length):
    seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 60)
            parts += [s[a:a + rng.randrange(40, 200)], prose(rng.randrange(0, 10))]
        texts.append("".join(parts))
    near = texts[3] + shared[0]
    texts += [near, near, near[:100] + "!" + near[100:], near[1:], "ab" * 300, "ab" * 77 + "c", "x" * 500, "", "short", "ababab" * 20, "Thue" * 30]
    return texts


@pytest.mark.parametrize("seed,most", [(1, 4096), (2, 1)])
def test_removed_bytes(spark, seed, most):
    texts = passages(seed)
    rows = [(i if i % 9 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash", "clash"), (7, None, "clash", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, first string").repartition(3)
    want = brute([(r[1] or "").encode() for r in rows], 64)
    got = suffix.remove_repeats(df, length=64, gram=20, most_spans=most).collect()
    flat = lambda x: sorted((str(a[0]), *a[1:]) for a in x)
    assert flat((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == flat((r[0], *w) for r, w in zip(rows, want))
    assert suffix.remove_repeats(df.where("false"), length=64, gram=20).collect() == []


def test_segments_cover_windows_and_follow_content(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc ") for _ in range(5000))
    whole = suffix.segments(text, 64, 20)
    monkeypatch.setattr(suffix, "PIECE", 700)
    for anchor, first, last in (whole, suffix.segments(text, 64, 20)):
        assert first[0] == 0 and last[-1] == len(text) - 64 and (first[1:] == last[:-1] + 1).all()
        assert ((anchor >= last) & (anchor + 20 <= first + 64)).all()
    monkeypatch.undo()
    # The anchor of a window is the same wherever the window stands.
    shifted = suffix.segments(b"#" * 137 + text, 64, 20)
    of = lambda s, p: s[0][np.searchsorted(s[1], p, side="right") - 1] - p
    assert all(of(whole, p) == of(shifted, p + 137) for p in range(0, len(text) - 63, 7))


def test_window_names_tell_windows_apart():
    spans = [b"abcabcabcabcabcabcabcabc", b"bcabcabcabcabcabcabcx", b"zzzzzzzzzzzzzzzzzzzzzzz"]
    name, owner = suffix.window_names(spans, 20)
    windows = [s[i:i + 20] for s in spans for i in range(len(s) - 19)]
    assert owner.tolist() == [k for k, s in enumerate(spans) for _ in range(len(s) - 19)]
    for a in range(len(windows)):
        for b in range(a):
            assert (name[a] == name[b]) == (windows[a] == windows[b])
