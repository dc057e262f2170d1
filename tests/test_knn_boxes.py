"""The neighbour index: few parts are met, and none that holds a neighbour is left out."""

import numpy as np
from pyspark.sql import functions as F

from mailspark.operators import knn


def test_a_test_point_meets_few_parts_beside_its_own(spark):
    """One wide column beside small-valued ones, as in the feature tables."""
    n, cols = 12_000, ["a", "b", "c", "d", "e"]
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double") for i, m in enumerate((100_000, 13, 4, 3, 2))]
    df = spark.range(n).select(F.col("id").alias("mail_id"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)).cast("int").alias("label"),
                               *[c.alias(name) for c, name in zip(h, cols)]).checkpoint()
    report = {}
    out = knn.knn_predict(df.where("mail_id % 5 <> 0"), df.where("mail_id % 5 = 0"), cols, k=5, report=report, part=100)
    got = {r.mail_id: r.y_prob for r in out.select("mail_id", "y_prob").collect()}
    assert len(got) == n // 5 and report["parts"] >= 90 and report["share_met"] * report["parts"] < 2.5
    rows = df.toPandas().sort_values("mail_id")
    x, label = rows[cols].to_numpy(), rows["label"].to_numpy()
    fit = np.arange(n) % 5 != 0
    z = (x - x[fit].mean(axis=0)) / x[fit].std(axis=0)
    for i in np.flatnonzero(~fit)[::40]:
        d = np.round(np.sqrt(((z[fit] - z[i]) ** 2).sum(axis=1)), 9)
        cut = np.sort(d)[4]
        near, tied = d < cut, d == cut
        assert abs(got[i] - (label[fit][near].sum() + (5 - near.sum()) * label[fit][tied].mean()) / 5) < 1e-9


def test_borders_leave_enough_points_on_either_side():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=4000), (np.arange(4000) % 1000 == 0) * 50.0, np.full(4000, np.nan)])
    index = knn.Index(x, 128)
    part = index.part_of(x)
    sizes = np.unique(part, return_counts=True)[1]
    assert len(sizes) >= 16 and sizes.min() >= 8 and sizes.max() < 256 and (index.column[part] < 0).all()


def test_all_boxes_within_reach_are_found():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(3000, 3)), rng.normal(size=(200, 3))
    index = knn.Index(x, 16)
    part = index.part_of(x)
    index.keep([(p, x[part == p].min(axis=0), x[part == p].max(axis=0)) for p in np.unique(part)])
    r = rng.uniform(0, 1, 200)
    found = set(zip(*[v.tolist() for v in index.within(q, r)]))
    d = np.sqrt(((q[:, None] - x) ** 2).sum(axis=2))
    assert {(i, int(part[j])) for i, j in zip(*np.nonzero(d <= r[:, None]))} <= found
