"""DuckDB SQL that recomputes each registered query independently.

Used by ``__spark_entry__.oracle_sql`` (the correctness gate) and the
tests.  The inputs are the supplied tables; derived relations come from the
shared fixture SQL.  DuckDB's regex engine has no look-ahead, so folded
header lines are protected with a placeholder character before splitting.
"""

from __future__ import annotations

from mailspark.operators import wide as W
from mailspark.sources.fixtures import (FEATURE_MATRIX_SQL, RAW_MAIL_SQL, SCORED_SQL,
                                        oracle_cte)

# --- header array and per-mail header values -------------------------------

_HEADERS = r"""
hl AS (
  SELECT mail_id, label, path, raw,
         list_filter(list_transform(string_split(regexp_replace(
             CASE WHEN starts_with(replace(raw, chr(13) || chr(10), chr(10)), chr(10)) THEN ''
                  ELSE split_part(replace(raw, chr(13) || chr(10), chr(10)), chr(10) || chr(10), 1) END,
             '\n([ \t])', chr(1) || '\1', 'g'), chr(10)), lambda l: replace(l, chr(1), chr(10))),
             lambda l: instr(l, ':') > 0 AND NOT regexp_matches(l, '^([ \t]|From )')) AS lines
  FROM raw_mail),
hh AS (
  SELECT mail_id, label, path, raw,
         list_transform(lines, lambda l, i: {'pos': CAST(i AS INTEGER), 'name': split_part(l, ':', 1),
                         'name_lc': lower(split_part(l, ':', 1)),
                         'value': regexp_replace(substr(l, instr(l, ':') + 1), '^[ \t]+', '')}) AS headers
  FROM hl)
"""


def _first(name: str) -> str:
    return f"list_filter(headers, lambda x: x.name_lc = '{name.lower()}')[1].value"


def _all(name: str) -> str:
    return f"list_transform(list_filter(headers, lambda x: x.name_lc = '{name.lower()}'), lambda x: x.value)"


def _present(name: str) -> str:
    return f"len(list_filter(headers, lambda x: x.name_lc = '{name.lower()}')) > 0"


def _auth_tok(proto: str) -> str:
    vals = f"list_concat({_all('Authentication-Results')}, {_all('ARC-Authentication-Results')})"
    toks = (f"list_filter(list_transform({vals}, lambda v: regexp_extract(lower(v), '{proto}\\s*=\\s*(\\S+)', 1)),"
            f" lambda t: t <> '')")
    return f"rtrim({toks}[1], ';,')"


_HV_VALUES = dict(W._VALUES)


def _hv() -> str:
    cols = [f"{_first(v)} AS {k}" for k, v in _HV_VALUES.items()]
    cols.append(f"{_all('Received')} AS recv")
    cols.append("list_transform(headers, lambda x: x.name_lc) AS names")
    for h in W.PRESENCE_HEADERS:
        cols.append(f"{_present(h)} AS p_{W.presence_name(h)}")
    for p in ("spf", "dkim", "dmarc"):
        cols.append(f"{_auth_tok(p)} AS tok_{p}")
    return "hv AS (SELECT mail_id, label, headers, " + ",\n  ".join(cols) + " FROM hh)"


def _dom(v: str) -> str:
    a = f"regexp_replace(lower(coalesce({v}, '')), '^\\s+|\\s+$', '', 'g')"
    ext = (f"CASE WHEN instr({a}, '@') > 0 THEN regexp_replace(regexp_replace(substr({a}, instr({a}, '@') + 1),"
           f" '^>+|>+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"
           f" ELSE regexp_extract({a}, '(?:[a-zA-Z0-9](?:[a-zA-Z0-9\\-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}', 0) END")
    return f"regexp_replace(regexp_replace(lower({ext}), '^[. ]+|[. ]+$', '', 'g'), '^www\\.', '')"


def _epoch(v: str) -> str:
    return f"epoch(try_strptime({v}, '%d %b %Y %H:%M:%S %z'))"


_RECV_RE = "(?is)from\\s+(\\S+).*?by\\s+(\\S+)"
_IP_RE = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"


def _hd() -> str:
    last = "recv[-1]"
    after = (f"CASE WHEN instr({last}, ';') > 0 THEN regexp_replace(substr({last}, instr({last}, ';') + 1),"
             f" '^\\s+|\\s+$', '', 'g') END")
    return f"""hd AS (SELECT *,
  {_dom('v_from')} AS d_from, {_dom('v_reply_to')} AS d_reply, {_dom('v_return_path')} AS d_rpath,
  {_dom('v_envelope_to')} AS d_env, {_dom('v_to')} AS d_to,
  CASE WHEN instr(coalesce(v_mid, ''), '@') > 0 THEN {_dom('v_mid')} ELSE '' END AS d_mid,
  CASE WHEN len(recv) > 0 THEN regexp_replace(regexp_replace(lower(regexp_extract({last}, '{_RECV_RE}', 1)),
      '^[. ]+|[. ]+$', '', 'g'), '^www\\.', '') ELSE '' END AS d_recv,
  CASE WHEN coalesce(v_date, '') <> '' THEN {_epoch('v_date')} END AS e_date,
  {_epoch(after)} AS e_recv,
  flatten(list_transform(recv, lambda r: regexp_extract_all(r, '{_IP_RE}', 0))) AS ips,
  list_filter(list_transform(recv, lambda r: nullif(regexp_extract(r, '[+-]\\d{{4}}', 0), '')), lambda t: t IS NOT NULL) AS tzs,
  list_filter(recv, lambda r: regexp_extract(r, '{_RECV_RE}', 1) <> '') AS matched
FROM hv)"""


def _i(e: str) -> str:
    return f"CAST(({e}) AS INTEGER)"


def _feature_sql() -> dict[str, str]:
    both = lambda a, b: f"({a} <> '' AND {b} <> '' AND {a} = {b})"
    f: dict[str, str] = {}
    for h in W.PRESENCE_HEADERS:
        f[W.presence_name(h)] = _i(f"p_{W.presence_name(h)}")
    f["has_spf"] = _i("tok_spf IS NOT NULL")
    f["has_dkim"] = _i("tok_dkim IS NOT NULL OR p_has_dkim_signature")
    f["has_dmarc"] = _i("tok_dmarc IS NOT NULL")
    f["from_domain_len"] = _i("length(d_from)")
    f["from_eq_reply_to_domain"] = _i(both("d_from", "d_reply"))
    f["from_eq_return_path_domain"] = _i(both("d_from", "d_rpath"))
    f["from_eq_mid_domain"] = _i(both("d_from", "d_mid"))
    f["from_eq_first_received_domain"] = _i(both("d_from", "d_recv"))
    f["reply_to_present_and_differs"] = _i("d_reply <> '' AND d_reply <> d_from")
    f["return_path_present_and_differs"] = _i("d_rpath <> '' AND d_rpath <> d_from")
    f["to_domain_eq_from_domain"] = _i(both("d_to", "d_from"))
    f["mid_domain_eq_from_domain"] = _i(both("d_mid", "d_from"))
    f["envelope_to_eq_from_domain"] = _i(both("d_env", "d_from"))
    f["reply_to_subdomain_of_from"] = _i("d_from <> '' AND d_reply <> '' AND ends_with(d_reply, '.' || d_from)")
    f["n_received_hops"] = _i("len(recv)")
    f["missing_received"] = _i("len(recv) = 0")
    f["malformed_received_hops"] = _i("len(recv) - len(matched)")
    f["n_unique_hop_ips"] = _i("len(list_distinct(ips))")
    f["n_private_ips_in_received"] = _i(
        "len(list_filter(ips, lambda ip: CAST(split_part(ip, '.', 1) AS INTEGER) = 10"
        " OR (CAST(split_part(ip, '.', 1) AS INTEGER) = 172 AND CAST(split_part(ip, '.', 2) AS INTEGER) BETWEEN 16 AND 31)"
        " OR (CAST(split_part(ip, '.', 1) AS INTEGER) = 192 AND CAST(split_part(ip, '.', 2) AS INTEGER) = 168)))")
    f["tz_mismatch_in_received"] = _i("len(list_distinct(tzs)) > 1")
    f["n_unique_tz_offsets"] = _i("len(list_distinct(tzs))")
    f["has_unusual_tz"] = _i("len(list_filter(tzs, lambda t: NOT regexp_matches(t, '^[+-](0[0-9]|1[0-4])00$'))) > 0")
    f["n_hop_domains"] = _i("len(list_distinct(flatten(list_transform(matched, lambda r: ["
                            f"regexp_extract(r, '{_RECV_RE}', 1), regexp_extract(r, '{_RECV_RE}', 2)]))))")
    f["date_vs_received_anomaly"] = _i("coalesce(abs(e_date - e_recv) > 86400, false)")
    f["excessive_hops"] = _i("len(recv) > 10")
    subj = "coalesce(v_subject, '')"
    cte = "regexp_replace(lower(coalesce(v_cte, '')), '^\\s+|\\s+$', '', 'g')"
    ct = "regexp_replace(lower(coalesce(v_ct, '')), '^\\s+|\\s+$', '', 'g')"
    mid = "coalesce(v_mid, '')"
    f["duplicate_headers"] = _i("len(names) - len(list_distinct(names))")
    f["subject_non_ascii"] = _i(f"regexp_matches({subj}, '[^\\x00-\\x7F]')")
    f["from_non_ascii"] = _i("regexp_matches(coalesce(v_from, ''), '[^\\x00-\\x7F]')")
    f["malformed_date"] = _i("coalesce(v_date, '') <> '' AND e_date IS NULL")
    f["subject_len"] = _i(f"length({subj})")
    f["subject_has_re"] = _i(f"starts_with(lower({subj}), 're:')")
    f["subject_all_caps"] = _i(f"upper({subj}) = {subj} AND lower({subj}) <> {subj} AND length({subj}) > 3")
    f["subject_exclaim_count"] = _i(f"length({subj}) - length(replace({subj}, '!', ''))")
    f["subject_question_count"] = _i(f"length({subj}) - length(replace({subj}, '?', ''))")
    f["has_mime_version"] = _i("coalesce(v_mime, '') <> ''")
    f["is_base64_encoded"] = _i(f"contains({cte}, 'base64')")
    f["is_quoted_printable"] = _i(f"contains({cte}, 'quoted-printable')")
    f["mid_malformed"] = _i(f"{mid} <> '' AND NOT regexp_matches(regexp_replace({mid}, '^\\s+|\\s+$', '', 'g'), '^<[^>]+@[^>]+>')")
    f["mid_len"] = _i(f"length({mid})")
    f["is_multipart"] = _i(f"contains({ct}, 'multipart')")
    f["is_html_only"] = _i(f"contains({ct}, 'text/html') AND NOT contains({ct}, 'multipart')")
    f["total_header_count"] = _i("len(names)")

    def enc(t: str) -> str:
        return (f"CAST(CASE WHEN {t} IS NULL THEN 0 WHEN contains(lower({t}), 'pass') THEN 1"
                f" WHEN contains(lower({t}), 'fail') OR contains(lower({t}), 'reject') THEN -1 ELSE 0 END AS INTEGER)")
    spf, dkim, dmarc = enc("tok_spf"), enc("tok_dkim"), enc("tok_dmarc")
    sig = "coalesce(v_dkim, '')"
    f["spf_result"], f["dkim_result"], f["dmarc_result"] = spf, dkim, dmarc
    f["dkim_signature_present"] = _i(f"{sig} <> ''")
    f["dkim_signature_valid_format"] = _i(f"{sig} <> '' AND contains({sig}, 'v=') AND contains({sig}, 'd=')")
    f["auth_results_present"] = _i("p_has_authentication_results")
    f["all_auth_pass"] = _i(f"{spf} = 1 AND {dkim} = 1 AND {dmarc} = 1")
    f["any_auth_fail"] = _i(f"{spf} = -1 OR {dkim} = -1 OR {dmarc} = -1")
    f["has_x_mailer"] = _i("coalesce(v_x_mailer, '') <> ''")
    f["x_mailer_len"] = _i("length(coalesce(v_x_mailer, ''))")
    f["x_priority_value"] = _i("coalesce(TRY_CAST(regexp_extract(coalesce(v_x_priority, ''), '[0-9]', 0) AS INTEGER), 3)")
    f["is_bulk_precedence"] = _i("regexp_replace(lower(coalesce(v_precedence, '')), '^\\s+|\\s+$', '', 'g') IN ('bulk', 'list', 'junk')")
    f["has_list_unsubscribe"] = _i("coalesce(v_list_unsub, '') <> ''")
    f["list_unsubscribe_len"] = _i("length(coalesce(v_list_unsub, ''))")
    addr = "'[\\w.+-]+@[\\w.-]+\\.[a-zA-Z]{2,}'"
    for k, v in (("n_to_addresses", "v_to"), ("n_cc_addresses", "v_cc"), ("n_bcc_addresses", "v_bcc")):
        f[k] = _i(f"len(regexp_extract_all(coalesce({v}, ''), {addr}, 0))")
    f["has_x_spam_status"] = _i("p_has_x_spam_status")
    f["x_spam_score"] = ("CASE WHEN coalesce(v_spam, '') <> '' THEN coalesce(TRY_CAST(regexp_extract(v_spam,"
                         " '(?i)score=([\\d.+-]+)', 1) AS DOUBLE), 0.0) ELSE 0.0 END")
    return f


FEATURE_SQL = _feature_sql()
assert set(FEATURE_SQL) == set(W.WIDE_FEATURES)


def _mail_prefix() -> str:
    return oracle_cte(raw_mail=RAW_MAIL_SQL) + "," + _HEADERS + "," + _hv() + ",\n" + _hd() + "\n"


def wide_sql(columns: list[str]) -> str:
    sel = ", ".join(f"{FEATURE_SQL[c]} AS {c}" for c in columns)
    return _mail_prefix() + f"SELECT mail_id, label, {sel} FROM hd"


def header_split_sql() -> str:
    return (oracle_cte(raw_mail=RAW_MAIL_SQL) + "," + _HEADERS +
            "SELECT mail_id, CAST(h.pos AS INTEGER) AS pos, h.name_lc AS name_lc,"
            " CAST(length(h.value) AS INTEGER) AS value_len, h.value AS value"
            " FROM (SELECT mail_id, unnest(headers) AS h FROM hh) t")


def prefix_for(kind: str) -> str:
    if kind == "raw_mail":
        return oracle_cte(raw_mail=RAW_MAIL_SQL)
    if kind == "scored":
        return oracle_cte(scored=SCORED_SQL)
    if kind == "feature_matrix":
        return oracle_cte(feature_matrix=FEATURE_MATRIX_SQL)
    raise KeyError(kind)


def mail_prefix() -> str:
    """CTEs raw_mail, hl, hh (header array), hv (values), hd (derived)."""
    return _mail_prefix()
