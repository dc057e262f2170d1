import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

import awkward
from mailspark.llm import importance_resampling as ir
from mailspark.llm.common import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, max_words=1, buckets=10_000, percent=10, min_words=20):
    """(doc_id, n_features, weight, score, rank) by definition."""
    def features(text):
        w = plain_words(text)
        return [crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, max_words + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for k, (i, text) in enumerate(docs):
        f = features(text)
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((k, i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= min_words))
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[0]))
    rank = {r[0]: n for n, r in enumerate(fit[:percent * len(fit) // 100], 1)}
    return sorted(((r[1], r[2], r[3], r[4], rank.get(r[0])) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("text", [None, "", " \n", "A b-C d\x85e É é_9", awkward.CLEAN, "x\x00y\x7fz\x80"])
def test_words(text):
    assert [w.decode() for w in ir.words_of(text)] == plain_words(text)


@pytest.mark.parametrize("max_words", [1, 2, 3])
@pytest.mark.parametrize("head", [0, 3, 10_000])
def test_head_and_tail_give_one_number(spark, max_words, head):
    rng = random.Random(max_words)
    docs = [(i, " ".join(rng.choice("ab cd ef gh ij é kl".split()) for _ in range(rng.choice([0, 5, 30, 90])))) for i in range(60)]
    target = ["ab cd ab cd", None, "é é kl"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = ir.resample(awkward.documents(spark, docs).repartition(5), df, max_words, buckets=101, percent=30, min_words=25, head=head)
    assert got(found) == plain(docs, target, max_words, 101, 30, 25)


def test_head_is_the_most_frequent(spark, monkeypatch):
    texts = spark.createDataFrame([("a a a b b c " + "y" * 100 + " " + "y" * 100,)] * 5, "text string").coalesce(1)
    words, pairs = ir.frequent(texts, 2, 2)
    assert words == {w: crc32(w) for w in (b"a", b"b")} and set(pairs) == {b"a a", b"a b"}
    counts = Counter({b"often": 50, **{b"%d" % k: 1 for k in range(100)}})
    assert ir._forget(counts, 10) == {b"often": 50}


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    target = [r.text for r in read(spark, sf, "benchmark").collect()]
    assert got(ir.op13_importance_resampling(spark, sf)) == plain(docs, target)


def test_awkward_rows(spark):
    target = spark.createDataFrame([(None, "the quick brown fox"), ("x", None)], "text string, other string").selectExpr(
        "other AS text", "text AS item_id")
    rows = awkward.TEXTS * 3
    want = plain(rows, ["the quick brown fox", None], percent=50)
    assert got(ir.resample(awkward.documents(spark, rows), target, percent=50)) == want
    empty = awkward.documents(spark, [])
    assert ir.resample(empty, target).count() == 0
    assert got(ir.resample(awkward.documents(spark, rows), target.limit(0), percent=50)) == plain(rows, [], percent=50)
    nulls = [(None, awkward.LONG)] * 4
    assert got(ir.resample(awkward.documents(spark, nulls), target, percent=50)) == plain(nulls, ["the quick brown fox", None], percent=50)
