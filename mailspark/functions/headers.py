"""Header access and text primitives: every function maps Columns to a Column.

The header block of a raw mail becomes
``ARRAY<STRUCT<pos INT, name STRING, name_lc STRING, value STRING>>``
(an ordered multimap: repeated names are kept, lookups are case-insensitive
and the first occurrence wins).  Everything runs inside one narrow
projection; no Python UDF except :func:`decode_mime` for encoded words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# --- fixed values: patterns that must equal the reference's ----------------
# IPv4 address (octets may carry leading zeros)
IP_RE = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
# domain name
DOMAIN_RE = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
# e-mail address (Python's \w is Unicode-aware, hence (?U))
EMAIL_ADDR_RE = r"(?U)[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}"
# time-zone offset
TZ_RE = r"[+-]\d{4}"
# Received hop "from X ... by Y", case-insensitive, dot matches newline
RECEIVED_FROM_RE = r"(?is)from\s+(\S+).*?by\s+(\S+)"
# ---------------------------------------------------------------------------


# begins and ends with a printable ASCII character: nothing to strip
_BARE = r"(?s)\A[!-~](?:.*[!-~])?\z"


def pystrip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.when(c.rlike(_BARE), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it several times inside ``fn`` (a lambda
    variable), so that composed expressions do not duplicate their inputs."""
    return F.get(F.transform(F.array(value), fn), 0)


_VALID_LINE = r"(?:[ \t]|From |[\x21-\x39\x3b-\x7e]*:)"
# name and value of each header line (continuation lines belong to the value)
_NAME_RE = r"(?md)^(?![ \t]|From )([^:\n]*):"
_VALUE_RE = r"(?md)^(?![ \t]|From )[^:\n]*:[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)"


def header_block(raw: Column) -> Column:
    """The header section of a raw RFC-2822 text.

    CRLF is normalised to LF, the section ends at the first empty line, a
    leading ``From `` envelope line is dropped and the section is cut at the
    first line that is neither a header, a continuation nor a ``From `` line.
    """
    # cut first: the body is passed over, never rewritten
    def line_ends(cut: Column) -> Column:
        # a CR before the line end that was cut off belongs to that line end
        half = (F.octet_length(cut) < F.octet_length(raw)) & cut.endswith("\r")
        own = F.when(half, cut.substr(F.lit(1), F.length(cut) - 1)).otherwise(cut)
        return F.when(cut.contains("\r"), F.replace(own, F.lit("\r\n"), F.lit("\n"))).otherwise(cut)

    def opened(lf: Column) -> Column:
        return F.when(lf.startswith("\n"), "").when(lf.startswith("From "), F.regexp_replace(
            lf, r"\A[^\n]*\n?", "")).otherwise(lf)

    blk = let(let(F.regexp_replace(raw, r"(?s)\n\r?\n.*", ""), line_ends), opened)
    # up to the first bad line, found in the block with a line end before it
    return F.regexp_replace(F.concat(F.lit("\n"), blk), r"(?s)\n(?!" + _VALID_LINE + ").*", "").substr(F.lit(2), F.length(raw))


def header_arrays(raw: Column) -> Column:
    """B1 (fast form): ``struct(names, names_lc, values)`` parallel arrays.

    Two regex passes over the header block; the value keeps folded
    continuation lines (newline + indent).
    """
    def build(b: Column) -> Column:
        return let(F.regexp_extract_all(b, F.lit(_NAME_RE), F.lit(1)), lambda names: F.struct(
            names.alias("names"), F.transform(names, F.lower).alias("names_lc"),
            F.regexp_extract_all(b, F.lit(_VALUE_RE), F.lit(1)).alias("values")))
    return let(header_block(raw), build)


def split_headers(raw: Column) -> Column:
    """B1: ordered ``ARRAY<STRUCT<pos, name, name_lc, value>>`` of a raw text."""
    def build(a: Column) -> Column:
        return F.transform(a["names"], lambda n, i: F.struct(
            (i + 1).alias("pos"), n.alias("name"), F.get(a["names_lc"], i).alias("name_lc"),
            F.get(a["values"], i).alias("value")))
    return let(header_arrays(raw), build)


def first_of(ha: Column, name: str) -> Column:
    """B2 on the fast form: first value of a header, null when absent."""
    return F.get(ha["values"], F.array_position(ha["names_lc"], F.lit(name.lower())).cast("int") - 1)


def all_of(ha: Column, name: str) -> Column:
    """B3 on the fast form: all values of a header in order."""
    lc = F.lit(name.lower())
    own = F.filter(ha["values"], lambda _, i: F.get(ha["names_lc"], i) == lc)
    # absent from most mails: told by generated code
    return F.when(has(ha, name), own).when(ha["names_lc"].isNotNull(), F.array().cast("array<string>"))


def has(ha: Column, name: str) -> Column:
    """B4 on the fast form."""
    return F.array_contains(ha["names_lc"], F.lit(name.lower()))


def header_first(headers: Column, name: str) -> Column:
    """B2: first value of a header (case-insensitive), null when absent."""
    lc = name.lower()
    return F.get(F.filter(headers, lambda h: h["name_lc"] == F.lit(lc)), 0)["value"]


def header_all(headers: Column, name: str) -> Column:
    """All values of a header in order."""
    lc = name.lower()
    return F.transform(F.filter(headers, lambda h: h["name_lc"] == F.lit(lc)), lambda h: h["value"])


def header_present(headers: Column, name: str) -> Column:
    """Header occurs (an empty value still counts)."""
    lc = name.lower()
    return F.exists(headers, lambda h: h["name_lc"] == F.lit(lc))


def nonempty(v: Column) -> Column:
    """``bool(value or '')``."""
    return F.coalesce(v, F.lit("")) != ""


def safe_lower(v: Column) -> Column:
    """``(v or '').lower().strip()``."""
    return pystrip(F.lower(F.coalesce(v, F.lit(""))))


def extract_domain(addr: Column) -> Column:
    """Text after the first '@' with '>' stripped, else first domain match."""
    return domain_of(safe_lower(addr))


def domain_of(a: Column) -> Column:
    """B7 of an address in lower case and stripped (a column: it is read several times)."""
    after_at = a.substr(F.instr(a, "@") + 1, F.length(a) + 1)
    return F.when(F.instr(a, "@") > 0, pystrip(F.btrim(after_at, F.lit(">")))) \
        .otherwise(F.regexp_extract(a, DOMAIN_RE, 0))


def normalize_domain(d: Column) -> Column:
    """Lower, strip dots and spaces at both ends, drop a ``www.`` prefix."""
    low = F.lower(d)
    bare = F.when(low.startswith("www."), low.substr(F.lit(5), F.length(low))).otherwise(low)
    return F.when((low == "") | low.rlike(r"\A[0-9a-z](?:[!-~]*[0-9a-z])?\z"), bare).otherwise(
        F.regexp_replace(F.regexp_replace(low, r"^[. ]+|[. ]+$", ""), r"^www\.", ""))


def has_non_ascii(v: Column) -> Column:
    """B9 as 0/1."""
    return F.coalesce(v, F.lit("")).rlike(r"[^\x00-\x7F]").cast("int")


def count_unicode_category(v: Column, category: str) -> Column:
    """Characters of a Unicode general category (e.g. 'C' control)."""
    return F.regexp_count(F.coalesce(v, F.lit("")), F.lit(r"\p{" + category + "}"))


def tz_offset(v: Column) -> Column:
    """First ``[+-]dddd`` in the text, null when none."""
    m = F.regexp_extract(F.coalesce(v, F.lit("")), TZ_RE, 0)
    return F.when(m != "", m)


def ipv4_all(v: Column) -> Column:
    """All IPv4 matches in order."""
    return F.regexp_extract_all(v, F.lit(IP_RE), F.lit(0))


def is_private_ip(ip: Column) -> Column:
    """RFC-1918 test on a dotted quad (leading zeros allowed)."""
    o1 = F.split_part(ip, F.lit("."), F.lit(1)).cast("int")
    o2 = F.split_part(ip, F.lit("."), F.lit(2)).cast("int")
    return (o1 == 10) | ((o1 == 172) & o2.between(16, 31)) | ((o1 == 192) & (o2 == 168))


def received_from(v: Column) -> Column:
    """B15 group 1: the ``from`` host of a Received value ('' when no match)."""
    return F.regexp_extract(v, RECEIVED_FROM_RE, 1)


def received_by(v: Column) -> Column:
    """B15 group 2: the ``by`` host (keeps a trailing ';')."""
    return F.regexp_extract(v, RECEIVED_FROM_RE, 2)


def count_addresses(v: Column) -> Column:
    """Number of e-mail addresses in the text."""
    return F.regexp_count(F.coalesce(v, F.lit("")), F.lit(EMAIL_ADDR_RE))


def auth_values(ha: Column) -> Column:
    """Authentication-Results values followed by ARC-Authentication-Results values."""
    return F.concat(all_of(ha, "Authentication-Results"), all_of(ha, "ARC-Authentication-Results"))


def auth_token(vals: Column, protocol: str) -> Column:
    """First ``protocol=token`` over ``vals`` (lower-cased), trailing ';,'
    removed; null when no value carries one."""
    pat = protocol + r"\s*=\s*(\S+)"
    toks = F.filter(F.transform(vals, lambda v: F.regexp_extract(F.lower(v), pat, 1)),
                    lambda t: t != "")
    return F.rtrim(F.get(toks, 0), F.lit(";,"))


def auth_result(ha: Column, protocol: str) -> Column:
    """The protocol's result token of a mail (``ha`` = fast header form)."""
    return auth_token(auth_values(ha), protocol)


def encode_auth_wide(tok: Column) -> Column:
    """Contains pass -> 1; fail or reject -> -1; else (or null) 0."""
    t = F.lower(tok)
    return (F.when(t.isNull(), 0).when(t.contains("pass"), 1)
            .when(t.contains("fail") | t.contains("reject"), -1).otherwise(0)).cast("int")


def encode_auth_compact(tok: Column) -> Column:
    """Pass -> 1; fail/softfail/hardfail/none/temperror/permerror -> -1; else 0."""
    t = pystrip(F.lower(F.coalesce(tok, F.lit(""))))
    neg = t.contains("fail") | t.contains("none") | t.contains("temperror") | t.contains("permerror")
    return F.when(t.contains("pass"), 1).when(neg, -1).otherwise(0).cast("int")


def encode_auth_repair(tok: Column) -> Column:
    """Pass -> 1; fail or none -> -1; neutral, temperror, permerror, other -> 0."""
    t = F.lower(F.coalesce(tok, F.lit("")))
    return F.when(t.contains("pass"), 1).when(t.contains("fail") | t.contains("none"), -1) \
        .otherwise(0).cast("int")


def spam_score(v: Column) -> Column:
    """``score=([\\d.+-]+)`` (case-insensitive) as double, 0 on failure."""
    m = F.regexp_extract(F.coalesce(v, F.lit("")), r"(?i)score=([\d.+-]+)", 1)
    return F.coalesce(m.try_cast("double"), F.lit(0.0))


def mid_malformed_wide(mid: Column) -> Column:
    """Non-empty and not starting with ``<x@y>``."""
    m = F.coalesce(mid, F.lit(""))
    return ((m != "") & ~pystrip(m).rlike(r"^<[^>]+@[^>]+>")).cast("int")


def mid_malformed_compact(mid: Column) -> Column:
    """Non-empty and not fully ``<x@y>`` without spaces or inner brackets."""
    m = F.coalesce(mid, F.lit(""))
    return ((m != "") & ~pystrip(m).rlike(r"^<[^<>@\s]+@[^<>@\s]+>$")).cast("int")


def sigmoid(x: Column) -> Column:
    """Logistic function with the argument clipped to [-500, 500]."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def class_to_label(c: Column) -> Column:
    """B26."""
    return F.when(c == 1, "malicious").otherwise("legitimate")


def to_number(v: Column) -> Column:
    """Numeric coercion of a string, JSON booleans as 1/0, bad -> 0."""
    s = F.lower(pystrip(v.cast("string")))
    # flags are told by their bytes; plain whole numbers, most of the other values, need one match
    text = v.cast("string")
    return F.when(text == "0", 0.0).when(text == "1", 1.0).when(text == "-1", -1.0).when(text.rlike(r"^-?[0-9]{1,9}\z"), text.cast("int").cast("double")) \
        .when(s == "true", 1.0).when(s == "false", 0.0) \
        .when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?inf(inity)?$"),
              F.coalesce(s.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def _decoder(lists: bool):
    """Decodes values, or lists of them; whole inside, so that it travels by value."""
    def one(v):  # pragma: no cover - runs in the Python worker
        from email.header import decode_header, make_header
        if v is None or "=?" not in v:
            return None if v is None else v.strip()
        try:
            return str(make_header(decode_header(v))).strip()
        except Exception:
            return v.strip()

    def run(s):  # pragma: no cover - runs in the Python worker
        return s.map((lambda vs: None if vs is None else [one(v) for v in vs]) if lists else one)
    return run


_decode_words = F.pandas_udf(_decoder(False), T.StringType())
_decode_lists = F.pandas_udf(_decoder(True), T.ArrayType(T.StringType()))


def unfold(v: Column) -> Column:
    """Remove folding line breaks (RFC 5322 unfolding)."""
    return F.regexp_replace(v, r"\r?\n(?=[ \t])", "")


def decode_mime(v: Column) -> Column:
    """Unfold, decode RFC 2047 encoded words, strip; failure -> raw text.

    Values without ``=?`` never leave the JVM; only the rare encoded ones go
    through an Arrow-batched UDF.
    """
    u = unfold(F.coalesce(v, F.lit("")))
    enc = u.contains("=?")
    # only encoded values are shipped (others travel as nulls in the batch)
    return F.when(enc, _decode_words(F.when(enc, u))).otherwise(pystrip(u))


def decode_mime_columns(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """B5 of several values as columns of ``df``: one list a mail goes to Python,
    and only of mails with an encoded word."""
    raw = {f"_u_{n}": unfold(F.coalesce(v, F.lit(""))) for n, v in values.items()}
    names = [F.col(u) for u in raw]
    some = F.lit(False)
    for u in names:
        some = some | u.contains("=?")
    df = df.withColumns(raw).withColumn("_decoded", _decode_lists(F.when(some, F.array(*names))))
    # one column a value: each is read several times
    return df.withColumns({n: F.when(F.col(u).contains("=?"), F.col("_decoded")[i]).when(
        F.col(u).rlike(_BARE), F.col(u)).otherwise(pystrip(F.col(u))) for i, (n, u) in enumerate(zip(values, raw))}).drop("_decoded", *raw)
