"""2.C: the wide header feature extractor (81 columns) as one narrow projection.

``wide_features(raw_mail)`` splits the header block once, pulls the header
values every feature needs into columns, then computes all features with
built-in expressions and higher-order functions.  No shuffle, no UDF; the
job scales with the number of input partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailspark.functions import headers as H
from mailspark.functions import per_context
from mailspark.functions.dates import mail_epoch

# --- fixed values: header names of the presence group, in output order ----
PRESENCE_HEADERS = [
    "Received", "Message-ID", "Date", "From", "To", "Reply-To",
    "Return-Path", "MIME-Version", "Content-Type",
    "Content-Transfer-Encoding", "Subject",
    "X-Mailer", "X-Originating-IP", "X-Spam-Status",
    "DKIM-Signature", "DomainKey-Signature",
    "Authentication-Results", "ARC-Authentication-Results",
    "Delivered-To", "Envelope-To", "Errors-To",
    "List-Unsubscribe", "Precedence", "X-Priority",
]
BULK_PRECEDENCE = ["bulk", "list", "junk"]
# ---------------------------------------------------------------------------


def presence_name(header: str) -> str:
    return "has_" + header.lower().replace("-", "_")


G1_COLUMNS = [presence_name(h) for h in PRESENCE_HEADERS] + ["has_spf", "has_dkim", "has_dmarc"]
G2_COLUMNS = [
    "from_domain_len", "from_eq_reply_to_domain", "from_eq_return_path_domain",
    "from_eq_mid_domain", "from_eq_first_received_domain", "reply_to_present_and_differs",
    "return_path_present_and_differs", "to_domain_eq_from_domain", "mid_domain_eq_from_domain",
    "envelope_to_eq_from_domain", "reply_to_subdomain_of_from",
]
G3_COLUMNS = [
    "n_received_hops", "missing_received", "malformed_received_hops", "n_unique_hop_ips",
    "n_private_ips_in_received", "tz_mismatch_in_received", "n_unique_tz_offsets",
    "has_unusual_tz", "n_hop_domains", "date_vs_received_anomaly", "excessive_hops",
]
G4_COLUMNS = [
    "duplicate_headers", "subject_non_ascii", "from_non_ascii", "malformed_date",
    "subject_len", "subject_has_re", "subject_all_caps", "subject_exclaim_count",
    "subject_question_count", "has_mime_version", "is_base64_encoded", "is_quoted_printable",
    "mid_malformed", "mid_len", "is_multipart", "is_html_only", "total_header_count",
]
G5_COLUMNS = [
    "spf_result", "dkim_result", "dmarc_result", "dkim_signature_present",
    "dkim_signature_valid_format", "auth_results_present", "all_auth_pass", "any_auth_fail",
]
MISC_COLUMNS = [
    "has_x_mailer", "x_mailer_len", "x_priority_value", "is_bulk_precedence",
    "has_list_unsubscribe", "list_unsubscribe_len", "n_to_addresses", "n_cc_addresses",
    "n_bcc_addresses", "has_x_spam_status", "x_spam_score",
]


def _ordered_union(*groups: list[str]) -> list[str]:
    out: list[str] = []
    for g in groups:
        out.extend(c for c in g if c not in out)
    return out


WIDE_FEATURES = _ordered_union(G1_COLUMNS, G2_COLUMNS, G3_COLUMNS, G4_COLUMNS,
                               G5_COLUMNS, MISC_COLUMNS)
assert len(WIDE_FEATURES) == 81

# header values pulled once per mail: column -> header name
_VALUES = {
    "v_from": "From", "v_reply_to": "Reply-To", "v_return_path": "Return-Path",
    "v_envelope_to": "Envelope-To", "v_to": "To", "v_mid": "Message-ID", "v_date": "Date",
    "v_subject": "Subject", "v_cte": "Content-Transfer-Encoding", "v_mime": "MIME-Version",
    "v_ct": "Content-Type", "v_dkim": "DKIM-Signature", "v_x_mailer": "X-Mailer",
    "v_x_priority": "X-Priority", "v_precedence": "Precedence",
    "v_list_unsub": "List-Unsubscribe", "v_cc": "Cc", "v_bcc": "Bcc",
    "v_spam": "X-Spam-Status",
}


def _i(c: Column) -> Column:
    return c.cast("int")


def header_values(df: DataFrame, headers_col: str = "ha") -> DataFrame:
    """Stage 2: header values, Received list, presence flags and auth tokens
    (``headers_col`` holds the fast parallel-array form)."""
    cols, toks = _value_columns(headers_col)
    # the three tokens read one shared list of authentication values
    return df.withColumns(cols).withColumns(toks)


@per_context
def _value_columns(headers_col: str):
    h = F.col(headers_col)
    cols = {k: H.first_of(h, v) for k, v in _VALUES.items()}
    cols["recv"] = H.all_of(h, "Received")
    cols["names"] = h["names_lc"]
    # a header that occurs has a value; a null mail has no flags
    looked_up = {v: cols[k] for k, v in _VALUES.items()}
    for name in PRESENCE_HEADERS:
        cols["p_" + presence_name(name)] = F.when(
            h["names_lc"].isNotNull(), looked_up[name].isNotNull()) if name in looked_up else H.has(h, name)
    cols["auth_vals"] = H.auth_values(h)
    return cols, {"tok_" + p: H.auth_token(F.col("auth_vals"), p) for p in ("spf", "dkim", "dmarc")}


#: domain column -> the header value it is taken from
_DOMAINS = {"d_from": "v_from", "d_reply": "v_reply_to", "d_rpath": "v_return_path", "d_env": "v_envelope_to",
            "d_to": "v_to", "d_mid": "v_mid"}


@per_context
def _domain_steps() -> list[dict[str, Column]]:
    """Columns one after another: each is read several times by the next ones, and
    evaluated once where it is a column."""
    recv, hosts = F.col("recv"), F.col("from_hosts")
    low = {"low_" + d: H.safe_lower(F.col(v)) for d, v in _DOMAINS.items()}
    low["from_hosts"] = F.transform(recv, H.received_from)
    mid = F.instr(F.col("v_mid"), "@") > 0  # a Message-ID without @ names no domain
    found = {"at_" + d: H.domain_of(F.col("low_" + d)) for d in _DOMAINS}
    found["at_d_mid"] = F.when(mid, found["at_d_mid"]).otherwise("")
    found["at_d_recv"] = F.when(F.size("recv") > 0, F.element_at(hosts, -1)).otherwise("")
    return [low, found, {d: H.normalize_domain(F.col("at_" + d)) for d in [*_DOMAINS, "d_recv"]} | {
        "ips": F.flatten(F.transform(recv, H.ipv4_all)),
        "tzs": F.filter(F.transform(recv, H.tz_offset), lambda t: t.isNotNull()),
        # hosts of the hops that match, from both sides
        "from_hosts": F.array_remove(hosts, ""),
        "by_hosts": F.array_remove(F.transform(recv, H.received_by), "")}]


@per_context
def _features() -> dict[str, Column]:
    c = F.col
    fd, rd, pd, ed, td, md, xd = (c(x) for x in ("d_from", "d_reply", "d_rpath", "d_env",
                                                  "d_to", "d_mid", "d_recv"))
    f: dict[str, Column] = {}
    # G1 presence
    for name in PRESENCE_HEADERS:
        f[presence_name(name)] = _i(c("p_" + presence_name(name)))
    f["has_spf"] = _i(c("tok_spf").isNotNull())
    f["has_dkim"] = _i(c("tok_dkim").isNotNull() | c("p_has_dkim_signature"))
    f["has_dmarc"] = _i(c("tok_dmarc").isNotNull())
    # G2 domains
    both = lambda a, b: (a != "") & (b != "") & (a == b)
    f["from_domain_len"] = _i(F.length(fd))
    f["from_eq_reply_to_domain"] = _i(both(fd, rd))
    f["from_eq_return_path_domain"] = _i(both(fd, pd))
    f["from_eq_mid_domain"] = _i(both(fd, md))
    f["from_eq_first_received_domain"] = _i(both(fd, xd))
    f["reply_to_present_and_differs"] = _i((rd != "") & (rd != fd))
    f["return_path_present_and_differs"] = _i((pd != "") & (pd != fd))
    f["to_domain_eq_from_domain"] = _i(both(td, fd))
    f["mid_domain_eq_from_domain"] = _i(both(md, fd))
    f["envelope_to_eq_from_domain"] = _i(both(ed, fd))
    f["reply_to_subdomain_of_from"] = _i((fd != "") & (rd != "") & rd.endswith(F.concat(F.lit("."), fd)))
    # G3 routing
    recv = c("recv")
    n = F.size(recv)
    ips, tzs = c("ips"), c("tzs")
    n_tz = F.size(F.array_distinct(tzs))
    hosts = F.concat(c("from_hosts"), c("by_hosts"))
    f["n_received_hops"] = _i(n)
    f["missing_received"] = _i(n == 0)
    f["malformed_received_hops"] = _i(n - F.size("from_hosts"))
    f["n_unique_hop_ips"] = _i(F.size(F.array_distinct(ips)))
    f["n_private_ips_in_received"] = _i(F.size(F.filter(ips, H.is_private_ip)))
    f["tz_mismatch_in_received"] = _i(n_tz > 1)
    f["n_unique_tz_offsets"] = _i(n_tz)
    f["has_unusual_tz"] = _i(F.exists(tzs, lambda t: ~t.rlike(r"^[+-](0[0-9]|1[0-4])00$")))
    f["n_hop_domains"] = _i(F.size(F.array_distinct(hosts)))
    f["date_vs_received_anomaly"] = _i(F.coalesce(F.abs(c("e_date") - c("e_recv")) > 86400, F.lit(False)))
    f["excessive_hops"] = _i(n > 10)
    # G4 structure
    names = c("names")
    subject = F.coalesce(c("v_subject"), F.lit(""))
    date_v = F.coalesce(c("v_date"), F.lit(""))
    mid = F.coalesce(c("v_mid"), F.lit(""))
    cte, ct = H.safe_lower(c("v_cte")), H.safe_lower(c("v_ct"))
    f["duplicate_headers"] = _i(F.size(names) - F.size(F.array_distinct(names)))
    f["subject_non_ascii"] = H.has_non_ascii(subject)
    f["from_non_ascii"] = H.has_non_ascii(c("v_from"))
    f["malformed_date"] = _i((date_v != "") & c("e_date").isNull())
    f["subject_len"] = _i(F.length(subject))
    f["subject_has_re"] = _i(F.lower(subject).startswith("re:"))
    f["subject_all_caps"] = _i((F.upper(subject) == subject) & (F.lower(subject) != subject)
                               & (F.length(subject) > 3))
    f["subject_exclaim_count"] = _i(F.length(subject) - F.length(F.replace(subject, F.lit("!"), F.lit(""))))
    f["subject_question_count"] = _i(F.length(subject) - F.length(F.replace(subject, F.lit("?"), F.lit(""))))
    f["has_mime_version"] = _i(H.nonempty(c("v_mime")))
    f["is_base64_encoded"] = _i(cte.contains("base64"))
    f["is_quoted_printable"] = _i(cte.contains("quoted-printable"))
    f["mid_malformed"] = H.mid_malformed_wide(mid)
    f["mid_len"] = _i(F.length(mid))
    f["is_multipart"] = _i(ct.contains("multipart"))
    f["is_html_only"] = _i(ct.contains("text/html") & ~ct.contains("multipart"))
    f["total_header_count"] = _i(F.size(names))
    # G5 authentication
    spf, dkim, dmarc = (H.encode_auth_wide(c("tok_" + p)) for p in ("spf", "dkim", "dmarc"))
    sig = F.coalesce(c("v_dkim"), F.lit(""))
    f["spf_result"], f["dkim_result"], f["dmarc_result"] = spf, dkim, dmarc
    f["dkim_signature_present"] = _i(sig != "")
    f["dkim_signature_valid_format"] = _i((sig != "") & sig.contains("v=") & sig.contains("d="))
    f["auth_results_present"] = _i(c("p_has_authentication_results"))
    f["all_auth_pass"] = _i((spf == 1) & (dkim == 1) & (dmarc == 1))
    f["any_auth_fail"] = _i((spf == -1) | (dkim == -1) | (dmarc == -1))
    # misc (has_x_mailer and has_list_unsubscribe: non-empty wins over presence)
    xm = F.coalesce(c("v_x_mailer"), F.lit(""))
    lu = F.coalesce(c("v_list_unsub"), F.lit(""))
    prio = F.regexp_extract(F.coalesce(c("v_x_priority"), F.lit("")), "[0-9]", 0)
    f["has_x_mailer"] = _i(xm != "")
    f["x_mailer_len"] = _i(F.length(xm))
    f["x_priority_value"] = _i(F.coalesce(prio.try_cast("int"), F.lit(3)))
    f["is_bulk_precedence"] = _i(H.safe_lower(c("v_precedence")).isin(*BULK_PRECEDENCE))
    f["has_list_unsubscribe"] = _i(lu != "")
    f["list_unsubscribe_len"] = _i(F.length(lu))
    f["n_to_addresses"] = _i(H.count_addresses(c("v_to")))
    f["n_cc_addresses"] = _i(H.count_addresses(c("v_cc")))
    f["n_bcc_addresses"] = _i(H.count_addresses(c("v_bcc")))
    f["has_x_spam_status"] = _i(c("p_has_x_spam_status"))
    f["x_spam_score"] = F.when(H.nonempty(c("v_spam")), H.spam_score(c("v_spam"))).otherwise(0.0)
    return f


@per_context
def _epochs() -> dict[str, Column]:
    date_v = F.coalesce(F.col("v_date"), F.lit(""))
    last = F.element_at(F.col("recv"), -1)
    rec = F.when(F.size("recv") > 0, last)
    after = F.when(F.instr(rec, ";") > 0, H.pystrip(rec.substr(F.instr(rec, ";") + 1, F.length(rec))))
    return {"e_date": F.when(date_v != "", mail_epoch(date_v)), "e_recv": mail_epoch(after)}


@per_context
def _arrays(raw_col: str):
    return H.header_arrays(F.col(raw_col))


def wide_features(raw_mail: DataFrame, raw_col: str = "raw",
                  keep: tuple[str, ...] = ("mail_id", "label"),
                  columns: list[str] | None = None) -> DataFrame:
    """C-ALL: ``keep`` columns + the 81 features (or the requested subset)."""
    keep = tuple(k for k in keep if k in raw_mail.columns)
    wanted = columns or WIDE_FEATURES
    df = raw_mail.select(*keep, _arrays(raw_col).alias("ha"))
    df = header_values(df)
    for step in _domain_steps():
        df = df.withColumns(step)
    df = df.withColumns(_epochs())
    feats = _features()
    return df.select(*keep, *[feats[c].alias(c) for c in wanted])
