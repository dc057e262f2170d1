import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import awkward
from mailspark.llm import golomb_dedup as gd
from mailspark.llm.common import read


def plain(rows):
    """(doc_id, keep_id, size, kept, sha) by definition, as a sorted list."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, (1 << 46) - 1), min_size=1, max_size=60))
def test_golomb_round_trip(values):
    gaps = np.array(values, dtype=np.uint64)
    assert gd.golomb_decode(gd.golomb_encode(gaps)).tolist() == values


def test_golomb_is_near_the_entropy():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 1 << 30, 10_000, dtype=np.uint64))
    size = 8 * len(gd.golomb_encode(np.diff(v, prepend=np.uint64(0))))
    assert size < 10_000 * (np.log2((1 << 30) / 10_000) + 2)


def some(n=400):
    rng = np.random.default_rng(n)
    out = []
    for k in range(n):
        t = f"text {rng.integers(0, n // 2)} é"
        out.append((int(rng.integers(0, n)) if k % 9 else None, t + " " * int(rng.integers(0, 4)) if k % 3 else t.replace(" ", "\n")))
    return out + [(9000 + k, "hot\ttext") for k in range(n // 2)]


@pytest.mark.parametrize("block_rows,owners,slack,bitmap_bytes", [
    (1 << 16, None, 10, 1 << 25), (7, 5, 10, 1 << 25), (7, 3, 0, 1 << 25), (5, 4, 10, 40), (1, 2, 1, 16)])
def test_blocks_owners_and_false_matches(spark, block_rows, owners, slack, bitmap_bytes):
    """Many blocks, short fingerprints (false suspects), ranges of bitmaps."""
    rows = some()
    docs = awkward.documents(spark, rows).repartition(6)
    assert rows_of(gd.exact_duplicates(docs, block_rows, owners, slack, bitmap_bytes)) == plain(rows)


def test_only_suspects_move(spark, tmp_path):
    """With all bits, suspects are exactly the rows of groups."""
    rows = some()
    path = str(tmp_path / "b")
    gd.write_blocks(awkward.documents(spark, rows).repartition(4), path, 50)
    blocks = spark.read.schema(gd.BLOCKS).parquet(path)
    bits = gd.bitmaps(blocks, 1 << 36, 3).checkpoint()
    found = gd.flagged(spark, blocks, bits).collect()
    assert sum(r.suspect for r in found) == sum(r[2] > 1 for r in plain(rows))
    assert all((r.norm is not None) == r.suspect for r in found)


def test_whole_query(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in gd.op12_golomb_dedup(docs).collect()), key=repr) == want


def test_awkward_rows(spark):
    docs = awkward.documents(spark)
    assert rows_of(gd.exact_duplicates(docs)) == plain(awkward.TEXTS)
    one = gd.drop_duplicates(docs)
    assert one.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in one.collect()), key=repr)
    by_norm = {re.sub(r"\s", "", t or "") for _, t in awkward.TEXTS}
    assert len(kept) == len(by_norm) and (1, awkward.CLEAN) in kept and (5, " \n\t \n") in kept
    assert gd.exact_duplicates(awkward.documents(spark, [])).count() == 0
    assert gd.drop_duplicates(awkward.documents(spark, [])).count() == 0
    twins = awkward.documents(spark, [(None, "a b")] * 3 + [(4, "ab")])
    assert [(r.doc_id, r.text) for r in gd.drop_duplicates(twins).collect()] == [(None, "a b")]
