import itertools
import random

import numpy as np
import pytest
import xxhash

import awkward
from mailspark.llm import simhash_variants as sv
from mailspark.llm.components import components
from mailspark.llm.common import read


def plain_fingerprint(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, max_bits):
    """Smallest index reachable for each fingerprint."""
    a = np.array(prints, dtype=np.uint64)
    label = list(range(len(a)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= max_bits) + i + 1:
            x, y = find(i), find(int(j))
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


@pytest.mark.parametrize("text", ["", " \n", "One two", "One two THREE four", "é A b\x85c d e f g h i j k É", awkward.CLEAN])
def test_fingerprint(text):
    assert sv.fingerprint(text) == plain_fingerprint(text)


def crowd(rng, n):
    """Fingerprints with chains, near groups and far ones."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 1, 3, 30])):
            y = rng.choice(out[-5:])
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5])):
                y ^= 1 << b
            out.append(y)
    return out[:n]


@pytest.mark.parametrize("max_bits,limit,seed", [(4, 8192, 1), (4, 3, 2), (3, 8192, 3), (3, 2, 4), (2, 2, 5), (1, 8192, 6), (0, 4, 7), (5, 8192, 8)])
def test_components_equal_brute_force(spark, max_bits, limit, seed):
    n = 400 if max_bits < 5 else 250
    prints = crowd(random.Random(seed), n)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    ids = spark.createDataFrame([(i, 0, f) for i, f in enumerate(signed)], "doc_id long, mark long, fp long")
    got = {r.fp: r.component_id for r in sv.near_duplicates(ids, max_bits, limit).collect()}
    assert [got[f] for f in signed] == brute_components(prints, max_bits)


def test_bucket_stream_cuts_batches(spark):
    """Buckets that run over Arrow batches, below and above the limit."""
    rng = random.Random(9)
    prints = sorted({0xABCDEF0000000000 ^ rng.getrandbits(12) for _ in range(900)})
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    ids = spark.createDataFrame([(i, 0, f) for i, f in enumerate(signed)], "doc_id long, mark long, fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for limit in (5, 100, 8192):
            got = {r.fp: r.component_id for r in sv.near_duplicates(ids, 4, limit).collect()}
            assert [got[f] for f in signed] == brute_components(prints, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_star_contraction(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_query(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in order]
    label = brute_components(prints, 4)
    want = {(i, f"{p:016x}", order[k]) for i, p, k in zip(order, prints, label)}
    assert {tuple(r) for r in sv.op10_simhash(docs).collect()} == want


def test_awkward_rows(spark):
    docs = awkward.documents(spark)
    rows = sv.op10_simhash(docs).collect()
    assert len(rows) == len(awkward.TEXTS)
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {3}  # texts without words link; the null id names no component
    one = sv.keep_one(docs)
    assert one.columns == docs.columns
    kept = [r.doc_id for r in one.collect()]
    assert kept.count(1) == 1 and 2 not in kept and kept.count(3) == 1 and 4 not in kept
    assert len(kept) == len({r.component_id for r in rows})
    assert sv.keep_one(awkward.documents(spark, [])).count() == 0
    nulls = sv.keep_one(awkward.documents(spark, [(None, awkward.CLEAN), (None, awkward.CLEAN)]))
    assert nulls.count() == 1
