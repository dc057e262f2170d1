import random
import time

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import awkward
from mailspark.llm import edit_counts as ec
from mailspark.llm.encoder import WordEncoder, vocabulary

WORDS = WordEncoder(vocabulary())
PLAIN = Tokenizer.from_file(vocabulary())


def full(text):
    return len(PLAIN.encode(text, add_special_tokens=False).ids)


TEXT = st.lists(st.sampled_from(["word", "Another.", "it's", " ", "\n", "  ", "12", "é", "<|endoftext|>", "a", "!!", "\u0301", "'", "3<|"]),
                max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 200), st.integers(0, 60), TEXT.map(lambda t: t[:20]), st.booleans()), max_size=8),
       st.integers(1, 4), st.sampled_from([2, 5, 2048]))
def test_edits_equal_recount(text, edits, leaf_words, leaf_chars):
    """Counted after every edit, or after several."""
    tree = ec.build_tree(text, WORDS, leaf_words, leaf_chars)
    assert tree.total == full(text) and int(tree.chars[1]) == len(text)
    edited = ec.EditedText(text, tree, WORDS)
    want = text
    for start, n, new, count in edits + [(0, 0, "", True)]:
        edited.edit(start, start + n, new)
        a = min(max(0, start), len(want))
        b = min(max(a, start + n), len(want))
        want = want[:a] + new + want[b:]
        assert edited.text == want and int(tree.chars[1]) == len(want)
        if count:
            edited.settle()
            assert tree.total == full(want)


def test_only_touched_leaves_are_encoded():
    text = " ".join(f"word{i}" for i in range(5000))
    tree = ec.build_tree(text, WORDS)
    edited = ec.EditedText(text, tree, WORDS)
    edited.edit(20_000, 20_004, "new")
    edited.settle()
    assert edited.encoded_chars < len(text) / 20
    assert tree.total == full(edited.text)


@pytest.mark.parametrize("unit", ["12345,", "letters", "\u65e5\u672c\u8a9e\u3002", "\u0e44\u0e17\u0e22", "word, and 7 "])
def test_long_texts_without_white_space(unit):
    """A million characters and ten thousand edits, each text counted once more at most."""
    text = unit * (1_000_000 // len(unit))
    words = WordEncoder(vocabulary())
    rng = random.Random(1)
    edits = [(rng.randrange(len(text)), rng.choice([0, 1, 7]), rng.choice(["", "5", "ab", " "])) for _ in range(10_000)]
    began = time.process_time()
    edited = ec.EditedText(text, ec.build_tree(text, words), words)
    for a, n, new in edits:
        edited.edit(a, a + n, new)
    edited.settle()
    assert time.process_time() - began < 60
    assert edited.encoded_chars <= len(edited.text)
    assert words.held <= words.memo_bytes and sum(map(len, words.memo)) < 1 << 20
    assert edited.tree.total == full(edited.text)


def test_query(spark):
    rng = random.Random(0)
    texts = awkward.TEXTS + [(100 + k, "\n".join(rng.choices(["same line here.", "mail a@b.cc now", "n 123456 n", "x"], k=9))) for k in range(20)]
    docs = awkward.documents(spark, texts)
    rows = sorted(ec.op1_edit_counts(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.n_chars))
    want = []
    for i, t in texts:
        t = t or ""
        edits = ec.cleaning_edits(t)
        after = t
        for a, b, s in edits:
            after = after[:a] + s + after[b:]
        want.append((i, full(t), len(edits), full(after), len(after)))
    want.sort(key=lambda r: (str(r[0]), r[3], r[4]))
    assert [(r.doc_id, r.n_tokens_before, r.n_edits, r.n_tokens, r.n_chars) for r in rows] == want
    assert ec.op1_edit_counts(awkward.documents(spark, [])).count() == 0


def test_stored_trees_serve_as_well(spark):
    from pyspark.sql import functions as F
    docs = awkward.documents(spark).filter("doc_id IN (1, 6, 7)")
    trees = ec.index_documents(docs)
    joined = docs.select("doc_id", "text").join(trees, "doc_id").withColumn("e", ec.edits_of(F.col("text")))
    a = joined.select("doc_id", ec.count_after_edits(F.col("text"), F.col("e"), F.struct("chars", "tokens")).alias("c"))
    b = joined.select("doc_id", ec.count_after_edits(F.col("text"), F.col("e")).alias("c"))
    assert sorted(a.collect()) == sorted(b.collect())
