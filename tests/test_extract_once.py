"""Compact extraction: values decoded once a mail, request maps without JSON, one date match."""

import contextlib
import io

from pyspark.sql import functions as F

from mailspark.functions import dates as D
from mailspark.functions import headers as H
from mailspark.operators import compact as CP
from mailspark.operators import score as SC

MAILS = [(1, 0, "Subject: =?utf-8?B?R3LDvMOfZQ==?= \nDate: 01 Jan 2020 10:20:30 +0000\nMessage-ID: <a@b.c>\n\nbody"),
         (2, 1, "Subject:  plain \n\t folded \nDate: =?utf-8?X?bad?=\nDKIM-Signature:\n\nbody"),
         (3, 0, "Authentication-Results: mx; spf=pass; dkim=fail\nReceived: a\nReceived: b\n\n"), (4, 1, ""), (5, None, None)]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_values_are_decoded_in_one_call(spark):
    mails = spark.createDataFrame(MAILS, "mail_id int, label int, raw string")
    feats = CP.compact_features(mails)
    # a list per mail goes to Python, not a column for each value
    assert plan(feats).count("pythonUDF") and "pythonUDF1" not in plan(feats)
    rows = {r.mail_id: r for r in feats.collect()}
    assert rows[1].subject_len == 5 and rows[1].date == "01 Jan 2020 10:20:30 +0000" and rows[1].malformed_date == 0
    assert rows[2].subject_len == len("plain \t folded") and rows[2].date == "=?utf-8?X?bad?=" and rows[2].malformed_date == 1
    assert rows[2].dkim_signature_present == 1 and rows[2].dkim_signature_valid_format == 0
    assert (rows[3].spf_result, rows[3].dkim_result, rows[3].n_received_hops, rows[3].any_auth_fail) == (1, -1, 2, 1)
    assert rows[4].subject_len == 0 and rows[4].date == ""
    values = ["  a ", "=?utf-8?B?R3LDvMOfZQ==?=", " x ", "x\n", None, "", "!", "a\n b"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert H.decode_mime_columns(df, {"d": F.col("v")}).where(~F.col("d").eqNullSafe(H.decode_mime(F.col("v")))).count() == 0


def test_request_maps_equal_json(spark):
    docs = spark.createDataFrame([("a", ("d", None), (1, None)), ("b", ("", 'q"\n'), (-3, 7)), ("c", (None, None), (None, None)), ("d", None, None)],
                                 "email_id string, headers struct<date:string,message_id:string>, header_features struct<x:int,y:int>")
    got = SC.documents_as_requests(docs)
    assert "from_json" not in plan(got)
    old = docs.select("email_id", *[F.from_json(F.to_json(c), "map<string,string>").alias(c) for c in ("headers", "header_features")])
    assert sorted(map(str, got.drop("body_urls").collect())) == sorted(map(str, old.collect()))


def test_numbers_and_dates_of_odd_spellings(spark):
    values = [("12", 12.0), (" 12", 12.0), ("-7", -7.0), ("12\n", 12.0), ("\x0012", 0.0), ("1234567890123", 1234567890123.0), ("+5", 5.0), ("", 0.0), ("true", 1.0)]
    df = spark.createDataFrame(values, "v string, want double")
    assert [r.got for r in df.select(H.to_number(F.col("v")).alias("got")).collect()] == [w for _, w in values]
    good = "01 Jan 2020 10:20:30 +0000"
    dates = spark.createDataFrame([(good,), ("Wed, " + good,), (good + " (x)",), (good + "\n",), (good + " \n",), ("not a date",)], "v string")
    first, *rest, bad = [r.e for r in dates.select(D.mail_epoch(F.col("v")).alias("e")).collect()]
    assert first == 1577874030.0 and set(rest) == {first} and bad is None
