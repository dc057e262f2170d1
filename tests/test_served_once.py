"""Scoring queries extract the mails once, whatever they do with the features; requests of a stream are written small."""

import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from mailspark.functions import headers as H
from mailspark.operators import compact as CP
from mailspark.operators import models as MD
from mailspark.operators import score as SC
from mailspark.plans import checked_queries, model_queries
from mailspark.plans import queries as Q
from mailspark.sources import fixtures as fx
from mailspark.sources.synthetic import fallback_training_table


@pytest.fixture
def mails(spark, monkeypatch):
    rows = [(i, i % 2, f"Subject: mail {'!' * (i % 7)}\nDate: 0{i % 9 + 1} Jan 2020 10:20:30 +0000\nMessage-ID: <{i}@b.c>\n"
             + ("X-Mailer: x\n" if i % 2 else "") + "\nbody") for i in range(40)]
    calls, real = [], CP.compact_features
    monkeypatch.setattr(fx, "raw_mail", lambda *_: spark.createDataFrame(rows, "mail_id long, label int, raw string"))
    monkeypatch.setattr(CP, "compact_features", lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


@pytest.mark.parametrize("query", [Q.q_score_batch, Q.q_score_dual, Q.q_detection_rate, Q.q_score_stream, checked_queries.q_score_fields,
                                   checked_queries.q_model_roundtrip, model_queries.q_score_dual_fields, model_queries.q_detection_counts])
def test_mails_are_extracted_once(spark, mails, monkeypatch, tmp_path, query):
    monkeypatch.setattr(Q, "scratch_dir", lambda _, name: str(tmp_path / name))
    out = query(spark, "")
    assert len(mails) == 1 and "pythonUDF" not in out._jdf.queryExecution().executedPlan().toString()
    n = out.count()
    if query is Q.q_score_stream:
        assert {p.suffix for p in (tmp_path / "requests").glob("part-*")} == {".gz"}
    if n == 1:
        row = out.first()
        assert (row["n"] if "n" in row else row["total"]) == 40 and row[1] in (20, 40, True)
    else:
        assert n == out.select("email_id").distinct().count() == 40
    if query is Q.q_score_batch:
        assert out.where((F.col("prediction") == "malicious") == (F.col("email_id").cast("int") % 2 == 1)).count() == 40


def test_trees_read_vectors_with_their_zeros(spark):
    model = MD.fit_pipeline(fallback_training_table(spark, 300), CP.COMPACT_FEATURES, num_trees=5, max_depth=3)
    requests = spark.createDataFrame([("a", {}, {"subject_len": "12"}, []), ("b", {}, {"spf_result": "-1", "has_date": "1"}, [])],
                                     "email_id string, headers map<string,string>, header_features map<string,string>, body_urls array<string>")
    dense = SC._probabilities(requests, model)
    assert all(isinstance(r.features, DenseVector) for r in dense.select("features").collect())
    plain = model.transform(SC.request_features(requests, CP.COMPACT_FEATURES))
    p = MD.vector_to_array("probability")
    assert plain.select("email_id", p[0], p[1]).exceptAll(dense.select("email_id", "_p0", "_p1")).count() == 0


def test_flags_are_numbers(spark):
    values = [("0", 0.0), ("1", 1.0), ("-1", -1.0), ("-0", 0.0), ("01", 1.0), (" 1", 1.0), (None, 0.0)]
    got = spark.createDataFrame(values, "v string, want double").select(H.to_number(F.col("v")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
