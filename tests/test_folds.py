"""Folds and hold-out number labels and ids; copies, nulls and empty tables have defined results."""

import pytest
from pyspark.sql import functions as F

from mailspark.operators import folds as FO

ROWS = [(1, 0, "a"), (1, 0, "b"), (None, 0, "c"), (None, 0, "d"), (2, None, "e"), (3, 1, "f"), (4, 1, "g"), (1, 1, "h")]
WAYS = [("fold", lambda d: FO.stratified_folds(d, 2)), ("is_test", lambda d: FO.holdout_split(d, 0.5)),
        ("fold", lambda d: FO.stratified_folds(d, 2, salt="inner"))]


@pytest.mark.parametrize("out,way", WAYS)
def test_copies_share_and_no_row_goes(spark, out, way):
    df = spark.createDataFrame(ROWS, "mail_id long, label int, x string")
    got = {r.x: r[out] for r in way(df).collect()}
    assert sorted(got) == list("abcdefgh")
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["e"] is None
    # two ids of each label: one on either side
    assert {got["a"], got["c"]} == {0, 1} and sorted((got["f"], got["g"], got["h"])) in ([0, 0, 1], [0, 1, 1])
    assert way(df.limit(0)).count() == 0


@pytest.mark.parametrize("out,way", WAYS)
def test_other_columns_stay_out_of_the_numbering(spark, out, way):
    """A column that fails when it is read does no harm until the result is read: only keys are numbered."""
    df = spark.range(200).select(F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"),
                                 F.raise_error(F.lit("read")).cast("string").alias("text"), F.lit(7).alias("_rn"))
    dealt = way(df)
    assert dealt.columns == ["mail_id", "label", "text", "_rn", out]
    sizes = dict(dealt.groupBy(out).count().collect())
    assert sorted(sizes.values()) == [100, 100]


@pytest.mark.parametrize("out,way", WAYS)
def test_dealt_again(spark, out, way):
    df = spark.createDataFrame(ROWS, "mail_id long, label int, x string")
    again = way(way(df).withColumn(out, F.lit(99)))
    assert again.columns == way(df).columns and sorted(again.collect(), key=str) == sorted(way(df).collect(), key=str)
