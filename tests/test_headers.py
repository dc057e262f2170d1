"""Header split, lookups, dates and domains on hand-written mails (cases the
derived corpus does not cover: CRLF, 8-bit bytes, -0000 zones, encoded
words, duplicate headers, envelope lines, a non-header line in the block)."""

from pyspark.sql import functions as F

from mailspark.functions import headers as H
from mailspark.functions.dates import mail_epoch
from mailspark.operators.compact import compact_features
from mailspark.operators.wide import wide_features


def _one(spark, raw, cols=None):
    df = spark.createDataFrame([(1, 0, raw)], "mail_id long, label int, raw string")
    return wide_features(df, columns=cols).first()


def test_split_crlf_folding_and_cut(spark):
    raw = ("From someone@x Mon Jan  1 00:00:00 2000\r\nSubject: a\r\n\tb\r\nsubject: dup\r\n"
           "X-Test:v\r\nnot a header line\r\nTo: late@x.example\r\n\r\nbody\r\n")
    df = spark.createDataFrame([(raw,)], "raw string").select(H.split_headers(F.col("raw")).alias("h"))
    h = df.first()["h"]
    assert [x["name"] for x in h] == ["Subject", "subject", "X-Test"]
    assert h[0]["value"] == "a\n\tb"
    assert h[2]["value"] == "v"
    first = df.select(H.header_first(F.col("h"), "SUBJECT").alias("s")).first()["s"]
    assert first == "a\n\tb"


def test_empty_and_missing_headers_give_defaults(spark):
    r = _one(spark, "\nbody only")
    assert r["total_header_count"] == 0 and r["missing_received"] == 1 and r["x_priority_value"] == 3
    r = _one(spark, "")
    assert r["total_header_count"] == 0


def test_duplicates_subject_and_non_ascii(spark):
    raw = "Subject: HELLO WORLD!!\nSubject: second\nFrom: Jörg <j@x.example>\n\n"
    r = _one(spark, raw)
    assert r["duplicate_headers"] == 1
    assert r["subject_all_caps"] == 1 and r["subject_exclaim_count"] == 2
    assert r["from_non_ascii"] == 1 and r["subject_non_ascii"] == 0


def test_domains_first_at_and_www(spark):
    raw = ("From: \"a@b\" <u@www.Example.COM.>\nReply-To: x@sub.example.com\n"
           "To: a@example.com, b@other.example\nMessage-ID: <1@example.com>\n\n")
    r = _one(spark, raw)
    # text after the FIRST '@' of From: 'b" <u@www.example.com.' -> no match with reply-to
    assert r["from_eq_reply_to_domain"] == 0
    assert r["n_to_addresses"] == 2


def test_auth_tokens_and_encodings(spark):
    raw = ("Authentication-Results: mx; spf=SoftFail; dkim=none\n"
           "ARC-Authentication-Results: i=1; dmarc=pass;\n"
           "DKIM-Signature: v=1; d=x\n\n")
    r = _one(spark, raw)
    assert (r["spf_result"], r["dkim_result"], r["dmarc_result"]) == (-1, 0, 1)
    assert r["has_spf"] == r["has_dkim"] == r["has_dmarc"] == 1
    assert r["dkim_signature_valid_format"] == 1 and r["any_auth_fail"] == 1


def test_routing_ips_zones_and_date_anomaly(spark):
    raw = ("Received: from a.example ([10.0.0.1]) by b.example; Mon, 1 Jan 2001 00:00:00 -0000\n"
           "Received: from c.example ([172.16.5.4]) by d.example;\n 3 Jan 2001 00:00:00 +0530\n"
           "Date: 1 Jan 2001 00:00:00 +0000\n\n")
    r = _one(spark, raw)
    assert r["n_received_hops"] == 2 and r["n_private_ips_in_received"] == 2
    assert r["has_unusual_tz"] == 1 and r["n_unique_tz_offsets"] == 2
    assert r["date_vs_received_anomaly"] == 1   # oldest hop is 2 days (minus 5.5 h) later
    assert r["n_hop_domains"] == 4


def test_date_table(spark):
    cases = {
        "Mon, 3 Oct 1998 10:20:30 -0400 (EDT)": 907424430.0,
        "3 Oct 98 10:20 GMT": 907410000.0,
        "Oct 3 1998 10:20:30 +0530": 907390230.0,
        "1 Jan 2000 10:00:00 -0000": 946720800.0,   # naive: read as UTC
        "1 Jan 2000 10:00:00+0100": 946717200.0,
        "31 Feb 2000 10:00:00 +0000": None,
        "2000-01-01T10:00:00": None,
        "not a date": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    got = {r["d"]: r["e"] for r in df.select("d", mail_epoch(F.col("d")).alias("e")).collect()}
    assert got == cases


def test_compact_decodes_encoded_words(spark):
    raw = ("Subject: =?utf-8?B?SMOpbGxv?=\nMessage-ID:  <a@b>\nAuthentication-Results: x; spf=pass;"
           " dkim=pass; dmarc=pass\nDKIM-Signature: v=1; a=r; b=x; bh=y; d=z; h=f; s=k\n\n")
    df = spark.createDataFrame([(1, 0, raw)], "mail_id long, label int, raw string")
    r = compact_features(df).first()
    assert r["subject_len"] == 5          # "Héllo"
    assert r["mid_malformed"] == 0 and r["all_auth_pass"] == 1 and r["dkim_signature_valid_format"] == 1


def test_header_block_is_cut_at_line_ends_of_both_kinds(spark):
    """Names and values stay side by side, characters beyond 16 bits count once."""
    cases = {
        "A: b\r\nC: d\r\n\r\nE: f\r\n\r\n": [("a", "b"), ("c", "d")],
        "A: b\nC: d\n\r\n\nE: f": [("a", "b"), ("c", "d")],
        "From x y\nA: b\nFrom w: z\nC:\n\td\n\nE: f": [("a", "b"), ("c", "\n\td")],
        "A: \U0001f600\U0001f600\nC: d\nno header\nE: f": [("a", "\U0001f600\U0001f600"), ("c", "d")],
        "\nA: b\n\n": [], "": [], "From x": [], "A: b\r": [("a", "b\r")], "A: b\n": [("a", "b")],
    }
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(cases)], "i int, raw string")
    got = df.select("i", H.header_arrays(F.col("raw")).alias("h")).orderBy("i").collect()
    assert [list(zip(r.h["names_lc"], r.h["values"])) for r in got] == list(cases.values())


def test_a_null_mail_has_no_presence_and_no_hops(spark):
    row = _one(spark, None, ["has_from", "has_x_mailer", "has_content_type", "n_received_hops", "missing_received"])
    assert (row.has_from, row.has_content_type, row.n_received_hops, row.missing_received) == (None, None, None, None)
