"""Scoring helpers: header lookup (B24), coercion (B27), v1 / v2 responses."""

from pyspark.sql import functions as F

from mailspark.operators import compact as CP
from mailspark.operators import models as MD
from mailspark.operators import score as SC
from mailspark.sources.synthetic import fallback_training_table


def test_header_value_and_coercion(spark):
    # maps read from JSON keep the document order of their keys (as requests do)
    raw = spark.createDataFrame(
        [('{"Message-ID": "<a@b>", "message_id": "", "DATE": "Sun, 21 Jun 2026 21:36:03 +0300"}',
          '{"spf_result": 1, "subject_len": "abc", "has_date": true, "extra": 9}')], "h string, f string")
    m = "map<string,string>"
    df = raw.select(F.from_json("h", m).alias("headers"), F.from_json("f", m).alias("header_features"))
    r = df.select(SC.header_value(F.col("headers"), "message_id", "Message-ID").alias("mid"),
                  SC.header_value(F.col("headers"), "date").alias("d")).first()
    # message_id and Message-ID normalise to the same key; the last entry ('') wins, so None
    assert r["mid"] is None and r["d"].startswith("Sun, 21 Jun 2026")
    f = SC.request_features(df, ["spf_result", "subject_len", "has_date", "missing"]).first()
    assert (f["spf_result"], f["subject_len"], f["has_date"], f["missing"]) == (1.0, 0.0, 1.0, 0.0)


def test_score_v1_v2_fields(spark):
    model = MD.fit_pipeline(fallback_training_table(spark, 300), CP.COMPACT_FEATURES, num_trees=5, max_depth=3)
    req = spark.createDataFrame(
        [("e1", {"date": "Sun, 21 Jun 2026 21:36:03 +0300", "message_id": "<x@y>"}, {"spf_result": "1"}, [])],
        "email_id string, headers map<string,string>, header_features map<string,string>, body_urls array<string>")
    v1 = SC.score_v1(req, model).first()
    assert v1["timestamp"] == "2026-06-21T18:36:03+00:00" and v1["message_id"] == "<x@y>"
    assert v1["prediction"] in ("malicious", "legitimate") and 0.5 <= v1["confidence"] <= 1.0
    v2 = SC.score_v2(req, model, "m").first()
    assert v2["feature_count"] == 24 and v2["feature_version"] == SC.FEATURE_VERSION
    assert abs(v2["malicious_probability"] + v2["legitimate_probability"] - 1.0) < 1e-3
    assert (v2["prediction"] == "malicious") == (v2["malicious_probability"] >= v2["legitimate_probability"])
