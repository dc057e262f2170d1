import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from mailspark.llm import orchard_codes as oc
from mailspark.llm.common import read

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("code", T.StringType()),
                       T.StructField("total", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "clash", "clash", "clash") for i, v, c in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2):
    """The same by definition: every distance, Python integers."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[max(-oc.MOST, min(oc.MOST, math.floor(256 * x))) for x in v[p * len(v) // parts:(p + 1) * len(v) // parts]] for p in range(parts)]
           for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            found = [near(p, c[p])[1] for c in cut]
            for k in set(found):
                mine = [c[p] for c, f in zip(cut, found) if f == k]
                books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in r) for r in last]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in r), e, sum(x for x, (_, _, d) in zip(error, kept) if d == c), digest)
            for (i, _, c), r, e in zip(kept, last, error)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("k,width,spread", [(1, 1, 3), (2, 3, 2), (64, 4, 40), (64, 4, 4), (100, 2, 5), (256, 8, 1000)])
def test_search_equals_every_distance(k, width, spread):
    """Few distinct values give many ties and equal entries."""
    rng = np.random.default_rng(k * width + spread)
    entries = rng.integers(-spread, spread + 1, (k, width))
    q = rng.integers(-2 * spread, 2 * spread + 1, (3000, width))
    best, dist, measured = oc.Lists(entries).search(q)
    far = ((q[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()
    assert measured <= far.size


def test_search_leaves_entries_out():
    rng = np.random.default_rng(0)
    entries, near = rng.integers(-5000, 5000, (256, 4)), rng.integers(-20, 20, (2000, 4))
    _, _, measured = oc.Lists(entries).search(entries[rng.integers(0, 256, 2000)] + near)
    assert measured < 0.2 * 2000 * 256


def test_whole_table_equals_definition(spark):
    df = read(spark, "/root/testdata/sf0.001", "embeddings")
    want = plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert order(oc.op11_orchard_codes(df).collect()) == order(want)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)

    def v():
        return rng.normal(0, 0.3, 32).astype(np.float32).tolist()
    same = v()
    rows = [(k, v(), k % 3) for k in range(90)]
    rows += [(5, same, None), (5, same, None), (None, v(), 1), (None, same, None), (200, [1e30] * 32, 2), (201, [-1e30] * 32, 2)]
    dropped = [(-1, None, 0), (-2, [None] + v()[1:], 0), (-3, [float("nan")] + v()[1:], 0), (-4, [float("inf")] + v()[1:], 1)]
    odd = [(-5, v()[:31], 0), (300, v() + v(), 0), (301, [], None)]
    got = oc.op11_orchard_codes(table(spark, rows + dropped + odd))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = got.collect()
    assert {r.vec_id for r in got if r.code is None} == {-5, 300, 301}
    assert all(r.error is None and r.label_error is None for r in got if r.code is None)
    assert order(r for r in got if r.code is not None) == order(plain(rows))


def test_few_and_no_rows(spark):
    rows = [(k, [float(k)] * 16, 0) for k in range(3)]
    assert order(oc.op11_orchard_codes(table(spark, rows)).collect()) == order(plain(rows))
    assert oc.op11_orchard_codes(table(spark, [])).count() == 0
    assert oc.op11_orchard_codes(table(spark, [(1, None, 0), (2, [1.0], 0)])).collect()[0].code is None
    with pytest.raises(ValueError):
        oc.train(oc.finite_vectors(table(spark, rows)), entries=257)


def test_other_sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-3, 4, 12).astype(float).tolist(), 0) for k in range(200)]
    kept = oc.finite_vectors(table(spark, rows))
    books = oc.train(kept, parts=4, entries=16, rounds=3)
    got = {r.vec_id: (r.code, r.error) for r in oc.encode(kept, books).collect()}
    assert got == {i: (c, e) for i, c, e, _, _ in plain(rows, 4, 16, 3)}
