import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import awkward
from mailspark.llm import bit_planes as bp
from mailspark.llm.common import read
from mailspark.llm.encoder import WordEncoder, vocabulary


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_and_files_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 64, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (bp.from_planes(bp.to_planes(ids, bits), n, bits) == ids).all()
    lengths = [3, 0, 500, 1, 129]
    ids = rng.integers(0, 50_000, sum(lengths), dtype=np.uint32)
    f = bp.PlaneFile(bp.build_file([5, None, 7, 7, -1], lengths, ids, bits, block=64))
    docs = list(f.documents())
    assert [d for d, _, _ in docs] == [5, None, 7, 7, -1]
    assert [len(x) for _, _, x in docs] == lengths and (np.concatenate([x for _, _, x in docs]) == ids).all()
    assert (f.chunk(3) == ids[192:256]).all()


@pytest.fixture(scope="module")
def pair():
    return WordEncoder(vocabulary(), memo_words=500), Tokenizer.from_file(vocabulary())


def same(pair, text):
    return np.frombuffer(pair[0].encode(text), "<u4").tolist() == pair[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_encoder_equals_tokenizer_on_any_text(pair, text):
    assert same(pair, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["it's", "Word.", "word,", "A1.", "é.", "É", "e\u0301", "<|endoftext|>", "<|STARTOFTEXT|>", "x<|", "..", ".",
                                 ",", "!!.", "\x1c", "\x85", "\u00a0", " ", "\n", "İ", "ß", "Σ", "12,5", "a.b", "K"]), max_size=14).map(
    lambda x: random.Random(len(x)).choice(["", " "]).join(x)))
def test_encoder_equals_tokenizer_on_odd_words(pair, text):
    assert same(pair, text)


def test_memo_is_bounded_in_bytes(pair):
    """Words of an unspaced script are as long as their texts and are not kept."""
    rng = random.Random(7)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x4E60)) for _ in range(3000)) for _ in range(40)]
    texts += [" ".join(f"w{rng.random()}" for _ in range(400)) for _ in range(40)] + ["", "a. b, ."]
    for counts in (False, True):
        words = WordEncoder(vocabulary(), memo_words=1000, counts=counts)
        for _ in range(2):
            got = list(words.count_all(texts)) if counts else [len(b) // 4 for b in words.encode_all(texts)]
            assert got == [len(pair[1].encode(t, add_special_tokens=False).ids) for t in texts]
        assert max(map(len, words.memo)) <= 64
        size = sum(len(w) + (0 if counts else len(v)) for w, v in words.memo.items())
        assert words.held >= size + 200 * len(words.memo) and not words.held > words.memo_bytes + (1 << 23)


def test_one_hot_id_is_dealt_to_many_ranges(spark, tmp_path):
    docs = awkward.documents(spark, [(None, f"text {k}") for k in range(600)] + [(k, "x") for k in range(30)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bp.write_files(docs, str(tmp_path / "f"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.schema(bp.WRITTEN).parquet(str(tmp_path / "f"))
    assert max(r.n_docs for r in files.collect()) < 400
    rows = sorted(bp.read_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 600 + list(range(30))


def test_files_of_the_query(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    t = Tokenizer.from_file(vocabulary())
    want, start = set(), 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.add((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in bp.op8_bit_planes(docs).collect()} == want


def test_awkward_rows(spark, tmp_path):
    docs = awkward.documents(spark)
    bp.write_files(docs, str(tmp_path / "f"), bits=1, file_ids=1000)
    rows = sorted(bp.read_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert len(rows) == len(awkward.TEXTS)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in awkward.TEXTS), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    assert bp.op8_bit_planes(awkward.documents(spark, [])).count() == 0
