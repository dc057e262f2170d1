"""2.D: the compact 24-feature extractor, its JSON documents, the 16 -> 24
upgrade and the authentication repair.

Values are unfolded and MIME-decoded (B5) before use, the authentication
features read only the first Authentication-Results header.  Like the wide
extractor this is one narrow projection per mail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailspark.functions import headers as H
from mailspark.functions import per_context
from mailspark.functions.dates import mail_epoch
from mailspark.operators.numbering import row_number_by

HEADER16 = ["has_message_id", "has_date", "has_from", "has_to", "has_subject", "has_content_type",
            "has_mime_version", "has_reply_to", "has_x_mailer", "has_x_originating_ip", "subject_len",
            "n_received_hops", "is_base64_encoded", "malformed_date", "mid_malformed", "has_x_priority"]
AUTH8 = ["spf_result", "dkim_result", "dmarc_result", "dkim_signature_present",
         "dkim_signature_valid_format", "auth_results_present", "all_auth_pass", "any_auth_fail"]
COMPACT_FEATURES = HEADER16 + AUTH8

# --- fixed values ----------------------------------------------------------
_PRESENCE16 = {"has_message_id": "Message-ID", "has_date": "Date", "has_from": "From", "has_to": "To",
               "has_subject": "Subject", "has_content_type": "Content-Type", "has_mime_version": "MIME-Version",
               "has_reply_to": "Reply-To", "has_x_mailer": "X-Mailer", "has_x_originating_ip": "X-Originating-IP",
               "has_x_priority": "X-Priority"}
DKIM_TAGS = ["v=", "a=", "b=", "bh=", "d=", "h=", "s="]
# first-line prefixes of a mail file (the sniff filter)
MAIL_PREFIXES = ["from ", "received:", "return-path:", "date:", "message-id:", "delivered-to:", "x-",
                 "subject:", "to:", "mime-version:", "content-type:", "content-transfer-encoding:"]
# ---------------------------------------------------------------------------


def _i(c: Column) -> Column:
    return c.cast("int")


# header values that are decoded once per mail: column -> header name
_DECODED = {"d_subject": "Subject", "d_date": "Date", "d_mid": "Message-ID", "d_cte": "Content-Transfer-Encoding",
            "d_auth": "Authentication-Results", "d_sig": "DKIM-Signature"}


@per_context
def _values():
    """The values to decode, and what else is read from the headers: these do
    not travel beside the values."""
    ha = F.col("ha")
    sig = H.first_of(ha, "DKIM-Signature")
    flags = {"h_" + name: _i(H.has(ha, header)) for name, header in _PRESENCE16.items()}
    flags |= {"h_hops": _i(F.size(H.all_of(ha, "Received"))), "h_sig": _i(sig.isNotNull()),
              "h_sig_text": _i(F.coalesce(sig, F.lit("")) != "")}
    return {"r" + c: H.first_of(ha, h) for c, h in _DECODED.items()} | flags


@per_context
def _read() -> dict[str, Column]:
    """Fields that several features read."""
    auth, date_v = F.col("d_auth"), F.col("d_date")
    toks = {f"t_{p}": F.when(auth != "", H.encode_auth_compact(F.regexp_extract(auth, rf"(?i){p}\s*=\s*(\S+)", 1))).otherwise(0)
            for p in ("spf", "dkim", "dmarc")}
    return {**toks, "e_date": F.when(date_v != "", mail_epoch(date_v))}


@per_context
def _compact_columns() -> dict[str, Column]:
    """D1 + D2 over the staged columns."""
    f: dict[str, Column] = {}
    for name in _PRESENCE16:
        f[name] = F.col("h_" + name)
    subject, date_v, mid, cte = F.col("d_subject"), F.col("d_date"), F.col("d_mid"), F.lower(F.col("d_cte"))
    f["subject_len"] = _i(F.length(subject))
    f["n_received_hops"] = F.col("h_hops")
    f["is_base64_encoded"] = _i(cte.contains("base64"))
    f["malformed_date"] = _i((date_v != "") & F.col("e_date").isNull())
    f["mid_malformed"] = H.mid_malformed_compact(mid)
    present = F.col("d_auth") != ""
    spf, dkim, dmarc = (F.col(f"t_{p}") for p in ("spf", "dkim", "dmarc"))
    sig = F.col("d_sig")
    valid = F.lit(True)
    for t in DKIM_TAGS:
        valid = valid & sig.contains(t)
    f["spf_result"], f["dkim_result"], f["dmarc_result"] = spf, dkim, dmarc
    f["dkim_signature_present"] = F.col("h_sig")
    f["dkim_signature_valid_format"] = F.col("h_sig_text") * _i(valid)
    f["auth_results_present"] = _i(present)
    f["all_auth_pass"] = _i(present & (spf == 1) & (dkim == 1) & (dmarc == 1))
    f["any_auth_fail"] = _i((spf == -1) | (dkim == -1) | (dmarc == -1))
    f["_date"] = date_v
    f["_message_id"] = mid
    return f


@per_context
def _arrays(raw_col: str):
    return H.header_arrays(F.col(raw_col))


def compact_features(raw_mail: DataFrame, raw_col: str = "raw",
                     keep: tuple[str, ...] = ("mail_id", "label")) -> DataFrame:
    """D1 + D2: ``keep`` columns + 24 feature columns (+ decoded date / message id)."""
    keep = tuple(k for k in keep if k in raw_mail.columns)
    df = raw_mail.select(*keep, _arrays(raw_col).alias("ha"))
    values = _values()
    df = df.select(*keep, *[v.alias(n) for n, v in values.items()])
    df = H.decode_mime_columns(df, {c: F.col("r" + c) for c in _DECODED}).withColumns(_read())
    cols = _compact_columns()
    return df.select(*keep, *[cols[c].alias(c) for c in COMPACT_FEATURES],
                     cols["_date"].alias("date"), cols["_message_id"].alias("message_id"))


def is_mail_text(raw: Column) -> Column:
    """First line, stripped and lower-cased, starts with a mail prefix."""
    first = F.lower(H.pystrip(F.split_part(raw, F.lit("\n"), F.lit(1))))
    pat = "^(" + "|".join(p.replace(".", r"\.") for p in MAIL_PREFIXES) + ")"
    return first.rlike(pat)


def documents(feats: DataFrame, id_col: str = "email_id") -> DataFrame:
    """D3 + D4: the feature-document structure (date / message id echo,
    24 features, empty body and attachments)."""
    return feats.select(
        F.col(id_col),
        F.struct(F.col("date"), F.col("message_id")).alias("headers"),
        F.struct(*[F.col(c) for c in COMPACT_FEATURES]).alias("header_features"),
        F.lit("").alias("body_text"),
        F.array().cast("array<map<string,string>>").alias("attachments"))


def extract_folder(raw_mail: DataFrame, start_index: int = 1, max_files: int = 0,
                   path_col: str = "path") -> DataFrame:
    """Sniff filter, path order, optional cap, running ``email_%04d`` ids
    (ids number the mail files, so a later failure would leave a gap)."""
    mails = raw_mail.where(is_mail_text(F.col("raw")))
    # the features are numbered, not the mails: no text travels through the shuffle
    numbered = row_number_by(compact_features(mails, keep=(path_col, "label")), [], [path_col], out="_n")
    if max_files > 0:
        numbered = numbered.where(F.col("_n") <= max_files)
    numbered = numbered.withColumn("email_id", F.format_string("email_%04d", F.col("_n") + (start_index - 1)))
    return documents(numbered)


def upgrade_documents(docs: DataFrame) -> DataFrame:
    """Documents with the 16 header features get the 8 auth features as
    zeros; 24-feature documents pass unchanged.  ``upgraded`` flags the rows."""
    hf = F.col("header_features")
    missing = hf["spf_result"].isNull()
    filled = hf
    for c in AUTH8:
        filled = filled.withField(c, F.coalesce(hf[c], F.lit(0)))
    return docs.withColumn("upgraded", missing.cast("int")) \
               .withColumn("header_features", F.when(missing, filled).otherwise(hf))


def repair_auth(docs: DataFrame, raw_mail: DataFrame) -> DataFrame:
    """D7 + D8: overwrite six auth fields of each document from the first mail
    (path order) whose text holds the document's Message-ID, re-extracted with
    the repair encoding (B20); unmatched documents pass unchanged.

    A mail is filed under every ``<...@...>`` token of its text and under its
    own Message-ID, reduced to the first path per id map-side (a hot id never
    lands whole in one task) and equi-joined.
    """
    m = raw_mail.select("path", "raw", H.header_arrays(F.col("raw")).alias("ha"))
    auth = H.decode_mime(H.first_of(F.col("ha"), "Authentication-Results"))
    toks = {p: F.regexp_extract(auth, rf"(?i){p}\s*=\s*(\S+)", 1) for p in ("spf", "dkim", "dmarc")}
    enc = {p: F.when(toks[p] != "", H.encode_auth_repair(toks[p])) for p in toks}
    # tokens that were found: all() is vacuously 1 and any() 0 without one
    found = F.filter(F.array(*[enc[p] for p in ("spf", "dkim", "dmarc")]), lambda x: x.isNotNull())
    fixed = m.select("path", "raw",
                     H.pystrip(H.decode_mime(H.first_of(F.col("ha"), "Message-ID"))).alias("_mid"),
                     F.coalesce(enc["spf"], F.lit(0)).alias("spf_result"),
                     F.coalesce(enc["dkim"], F.lit(0)).alias("dkim_result"),
                     F.coalesce(enc["dmarc"], F.lit(0)).alias("dmarc_result"),
                     (auth != "").cast("int").alias("auth_results_present"),
                     F.exists(found, lambda x: x == -1).cast("int").alias("any_auth_fail"),
                     F.forall(found, lambda x: x == 1).cast("int").alias("all_auth_pass"))
    repaired = ["spf_result", "dkim_result", "dmarc_result", "auth_results_present", "any_auth_fail", "all_auth_pass"]
    ids = F.array_distinct(F.array_append(
        F.regexp_extract_all("raw", F.lit(r"(<[^<>\s]+@[^<>\s]+>)"), 1), F.col("_mid")))
    filed = fixed.select(F.explode(ids).alias("_mid"), "path", *repaired).where("_mid <> ''")
    first = filed.groupBy("_mid").agg(F.min_by(F.struct("path", *repaired), F.col("path")).alias("_m"))
    d = docs.withColumn("_doc_mid", H.pystrip(F.col("headers.message_id")))
    j = d.join(first, F.col("_doc_mid") == F.col("_mid"), "left")
    hf = F.col("header_features")
    new = hf
    for c in repaired:
        new = new.withField(c, F.col("_m").getField(c))
    return j.select(*[c for c in docs.columns if c != "header_features"],
                    F.when(F.col("_m").isNotNull(), new).otherwise(hf).alias("header_features"),
                    F.col("_m").isNotNull().cast("int").alias("fixed"))
