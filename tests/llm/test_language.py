import math
import random
import zlib
from collections import Counter

import pytest

from tidepanel.llm.language import build_model, identify_language, is_held_out, keep_identified, train

TEXTS = {"aa": "banana bandana cabana", "bb": "the quick brown fox thinks", "cc": "straße über größe"}


def grams(text):
    data = b"   " + text.lower().encode()
    return [data[k:k + 4] for k in range(len(data) - 3)]


def brute_cost(counts, language, text, alphabet, least):
    """Method C from the definition, contexts kept if some language saw them often enough."""
    def table(lang, order):
        out = {}
        for (l, g), n in counts.items():
            if l == lang:
                out.setdefault(g[3 - order:3], Counter())[g[3:]] += n
        return out

    langs = {l for l, _ in counts}
    tables = {(l, k): table(l, k) for l in langs for k in range(4)}
    bits = 0.0
    for g in grams(text):
        context, c, p = g[:3], g[3:], 1.0
        longest = max(k for k in range(4) if k == 0 or any(sum(tables[l, k].get(context[3 - k:], {}).values()) >= least for l in langs))
        for k in range(longest, -1, -1):
            seen = tables[language, k].get(context[3 - k:])
            if not seen:
                continue
            total, different = sum(seen.values()), len(seen)
            if c in seen:
                bits -= math.log2(p * seen[c] / (total + different))
                break
            p *= different / (total + different)
        else:
            bits -= math.log2(p / alphabet)
    return bits


@pytest.mark.parametrize("text", ["banana", "über the cabana", "zzz ñ", "x" * 40, "The Quick"])
def test_costs_are_those_of_the_definition(text):
    counts = Counter((l, g) for l, t in TEXTS.items() for g in grams(t))
    model = build_model([(l, g, n) for (l, g), n in counts.items()])
    alphabet = len({bytes([b]) for _, g in counts for b in g}) + 1
    assert model.score(text) == pytest.approx([brute_cost(counts, l, text, alphabet, 2) for l in sorted(TEXTS)], rel=1e-5)


def test_long_texts_cost_the_sum_of_their_pieces():
    model = build_model([(l, g, 1) for l, t in TEXTS.items() for g in grams(t)])
    text = "".join(random.Random(1).choice("abc the ") for _ in range(150_000))
    one = model.score(text)
    assert (one > 150_000).all() and model.predict(text) == model.predict(text)
    assert model.score("")[0] == 0 and model.predict("12 !")[0] == "und" and model.predict(None) == ("und", 0.0)
    assert build_model([]).predict("abc") == ("und", 0.0)


def test_held_out_rows_and_odd_rows(spark, odd, nothing):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(TEXTS[l].split()) for _ in range(30)), l, "s") for i in range(300) for l in [sorted(TEXTS)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in identify_language(df).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(got[i].lang_pred == l and 0 <= got[i].score <= 1 for i, _, l, _ in rows)
    # Labels of held-out rows change nothing.
    other = df.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) lang", "source")
    assert {r.doc_id: r.lang_pred for r in identify_language(other).collect()} == {i: r.lang_pred for i, r in got.items()}
    found = identify_language(odd).collect()
    assert len(found) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in found:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert identify_language(nothing).collect() == [] and keep_identified(nothing).collect() == []
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in found)
    assert df.where(is_held_out(df.doc_id)).count() == sum(r.held_out for r in got.values())


def test_texts_with_a_letter_stay_if_there_is_nothing_to_learn_from(spark, odd):
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source")
    letters = sorted(r.text for r in odd.collect() if any(c.isalpha() for c in r.text or ""))
    assert sorted(r.text for r in keep_identified(unlabelled).collect()) == letters


def test_no_language_is_left_out(spark):
    """More labels than documents in the sample: each label keeps its own."""
    letters = "bcdfghjklmnpqrstvwxz"
    words = {f"l{i:03d}": "".join(letters[(i // 20**k) % 20] + "aeiou"[(i + k) % 5] for k in range(3)) for i in range(230)}
    rows = [(4 * n + k, f"{w} {w}{w} {w}", lang) for n, (lang, w) in enumerate(words.items()) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, most_docs=240)
    assert sorted(model.languages) == sorted(words)
