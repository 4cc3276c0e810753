import bisect
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepanel.llm.binary_tokens import TokenReader, TokenWriter, binary_round_trip, pack, unpack
from tidepanel.llm.encoder import WordEncoder
from tidepanel.llm.packing import best_plan, pack_documents
from tidepanel.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODE = WordEncoder(PATH, cache=50)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def with_end(text):
    return np.array(ids(text) + [0], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sdt  \n\t.,!x1²½éßÉжΩ—“\xa0\x85中😀"), st.characters(codec="utf-8")), max_size=60))
def test_encoder_gives_the_librarys_ids(text):
    assert CODE.encode(text).tolist() == ids(text)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing_of_bits(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = pack(values, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (unpack(data, 1001, bits) == values).all()


def test_random_access_across_blocks():
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    writer = TokenWriter(out, 11, 16)
    docs = [np.arange(n, dtype=np.uint32) for n in (1, 40, 16, 3, 100)]
    for i, d in enumerate(docs):
        writer.add(i or None, d)
    writer.close()
    reader = TokenReader(pa.BufferReader(out.getvalue()))
    whole = np.concatenate(docs)
    for a, b in [(0, 160), (15, 17), (41, 41), (57, 60), (159, 160)]:
        assert (reader.ids(a, b) == whole[a:b]).all()
    assert reader.null.tolist() == [1, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        writer.add(9, np.array([1 << 11], np.uint32))


def test_token_files_round_trip(spark, odd, nothing):
    got = sorted(binary_round_trip(spark, odd, PATH).collect(), key=lambda r: r.start)
    rows = odd.collect()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    crcs = lambda x: sorted((str(i), n, c) for i, n, c in x)
    assert crcs((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crcs((r.doc_id, len(with_end(r.text)), zlib.crc32(with_end(r.text).tobytes())) for r in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert binary_round_trip(spark, nothing, PATH).collect() == []


def test_pieces_fill_sequences_without_gaps(odd, nothing):
    got = pack_documents(odd, PATH, length=256).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= 256
        assert r.piece == 0 or r.length == 256
    total = sum(r.length for r in got)
    assert total == sum(len(with_end(r.text)) for r in odd.collect())
    assert len(ends) <= -(-total // 256) + 1
    assert sorted(ends) == list(range(len(ends)))
    x = with_end(next(r.text for r in odd.collect() if r.doc_id == 11))
    for r in (r for r in got if r.doc_id == 11):
        assert r.ids_crc32 == zlib.crc32(x[r.start:r.start + r.length].tobytes())
    assert pack_documents(nothing, PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(512, np.exp(rng.normal(4.5, 1, 5000)).astype(int) + 1)
    size, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(size.tolist(), n.tolist()))
    plan = best_plan(counts, 512)
    assert plan.used == counts
    fill = np.zeros(plan.sequences, int)
    for length, first, n, sequence, per, offset in plan.places:
        k = np.arange(n)
        np.add.at(fill, sequence + k // per, length)
    assert fill.max() <= 512 and plan.sequences <= 1.01 * lengths.sum() / 512 + 1
    assert len(plan.places) < 512 * 8


def test_tokens_belong_to_the_section_of_their_first_byte(odd, nothing):
    got = {}
    for r in count_tokens(odd, PATH).collect():
        got.setdefault((r.doc_id, r.section), []).append(r)
    for row in odd.collect():
        text = row.text or ""
        lines = [l + "\n" for l in text.split("\n")]
        lines[-1] = lines[-1][:-1]
        if len(lines) > 1 and not lines[-1]:
            lines.pop()
        ends = np.cumsum([len(l) for l in lines]).tolist()
        if not text.isascii():
            assert sum(r.n_tokens for k, rs in got.items() if k[0] == row.doc_id for r in rs) >= len(ids(text))
            continue
        n, cross = [0] * len(lines), [0] * len(lines)
        for a, b in LIBRARY.encode(text, add_special_tokens=False).offsets:
            k = bisect.bisect_right(ends, a)
            n[k] += 1
            cross[k] += b > ends[k]
        for k, line in enumerate(lines):
            assert any((r.n_bytes, r.n_tokens, r.n_crossing) == (len(line), n[k], cross[k]) for r in got[row.doc_id, k])
    assert count_tokens(nothing, PATH).collect() == []


def test_fields_share_one_encoding(spark):
    df = spark.createDataFrame([(1, "ab", None, "x y")], "doc_id long, a string, b string, c string")
    got = {r.field: r for r in count_tokens(df, PATH, fields=("a", "b", "c")).collect()}
    assert sum(r.n_tokens for r in got.values()) == len(ids("ab\n\n\n\nx y"))
    assert (got["b"].n_bytes, got["c"].start) == (0, 6)
