"""RFC-2822 mail dates as Column expressions.

The tokenizer follows the lenient rules of the Python standard library's
date parser (weekday dropped, day/month order swapped when needed, glued
zone split off, missing seconds, two-digit years, named zones), so that the
``malformed_date`` flag and the date anomaly agree with it.  Result:
epoch seconds (DOUBLE, UTC) or null when the text is not a date.  A missing
or unknown zone (and ``-0000``) means "naive"; naive dates are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailspark.functions.headers import let

# --- fixed values: names and offsets the standard library accepts ----------
DAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun",
               "jul", "aug", "sep", "oct", "nov", "dec",
               "january", "february", "march", "april", "may", "june",
               "july", "august", "september", "october", "november", "december"]
ZONE_OFFSETS = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
                "AST": -400, "ADT": -300, "EST": -500, "EDT": -400,
                "CST": -600, "CDT": -500, "MST": -700, "MDT": -600,
                "PST": -800, "PDT": -700}
# ---------------------------------------------------------------------------


def _strip_comma(c: Column) -> Column:
    return F.regexp_replace(c, ",$", "")


def _drop_weekday(toks: Column) -> Column:
    first = F.get(toks, 0)
    drop_first = first.endswith(",") | F.lower(first).isin(*DAY_NAMES)
    return F.when(drop_first, F.slice(toks, F.lit(2), F.size(toks))).otherwise(
        F.when(F.instr(first, ",") > 0,
               F.concat(F.array(F.substring_index(first, ",", -1)), F.slice(toks, F.lit(2), F.size(toks))))
        .otherwise(toks))


def _rfc850(toks: Column) -> Column:
    # "01-Jan-2000 10:00:00 GMT": three tokens, the first one dashed
    return let(F.split(F.get(toks, 0), "-"), lambda dashed: F.when(
        (F.size(toks) == 3) & (F.size(dashed) == 3),
        F.concat(dashed, F.slice(toks, F.lit(2), F.size(toks)))).otherwise(toks))


def _split_zone(toks: Column) -> Column:
    # four tokens: a zone glued to the time ("10:20:30+0000"), else no zone
    t3 = F.coalesce(F.get(toks, 3), F.lit(""))

    def go(cut: Column) -> Column:
        return F.when(F.size(toks) == 4,
                      F.when(cut > 1, F.concat(F.slice(toks, 1, 3),
                                               F.array(t3.substr(F.lit(1), cut - 1),
                                                       t3.substr(cut, F.length(t3)))))
                      .otherwise(F.concat(toks, F.array(F.lit(""))))).otherwise(toks)
    return let(F.when(F.instr(t3, "+") > 0, F.instr(t3, "+")).otherwise(F.instr(t3, "-")), go)


def _fields(toks: Column) -> Column:
    """Five raw tokens -> struct(ok, y, m, d, tm, tz) after the swaps."""
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    dd, mm, yy, tm, tz = (F.get(toks, i) for i in range(5))
    mm_ok = F.array_contains(months, F.lower(mm))
    dd2 = F.when(mm_ok, dd).otherwise(mm)
    mm2 = F.when(mm_ok, F.lower(mm)).otherwise(F.lower(dd))
    ok = (F.size(toks) >= 5) & (dd != "") & (mm != "") & (yy != "") & F.array_contains(months, mm2)
    yy_is_time = F.instr(yy, ":") > 0
    yy2 = _strip_comma(F.when(yy_is_time, tm).otherwise(yy))
    tm2 = F.when(yy_is_time, yy).otherwise(tm)
    return F.struct(ok.alias("ok"), F.array_position(months, mm2).alias("m"),
                    _strip_comma(dd2).alias("d"), yy2.alias("y"), tm2.alias("tm"), tz.alias("tz"))


def _numbers(p: Column) -> Column:
    yy_digit = p["y"].rlike("^[0-9]")
    yy3 = F.when(yy_digit, p["y"]).otherwise(p["tz"])
    tz2 = F.when(yy_digit, p["tz"]).otherwise(p["y"])
    tm2 = _strip_comma(p["tm"])
    tparts = let(F.split(tm2, ":"), lambda tp: F.when(
        (F.size(tp) == 1) & (F.instr(tm2, ".") > 0), F.split(tm2, r"\.")).otherwise(tp))

    def build(tp: Column) -> Column:
        hh = F.get(tp, 0).try_cast("int")
        mi = F.get(tp, 1).try_cast("int")
        ss = F.when(F.size(tp) == 3, F.get(tp, 2)).otherwise(F.lit("0")).try_cast("int")
        y = yy3.try_cast("int")
        d = p["d"].try_cast("int")
        ok = p["ok"] & F.size(tp).isin(2, 3) & y.isNotNull() & d.isNotNull() \
            & hh.isNotNull() & mi.isNotNull() & ss.isNotNull()
        m = F.when(p["m"] > 12, p["m"] - 12).otherwise(p["m"])
        return F.when(ok, F.struct(y.alias("yy"), m.alias("mm"), d.alias("dd"), hh.alias("hh"),
                                   mi.alias("mi"), ss.alias("ss"), F.upper(tz2).alias("tz")))
    return let(tparts, build)


def mail_date_parts(s: Column) -> Column:
    """Struct (yy, mm, dd, hh, mi, ss, tz) of a mail date, or null."""
    toks = F.filter(F.split(F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", ""), r"\s+"),
                    lambda t: t != "")
    toks = let(toks, _drop_weekday)
    toks = let(toks, _rfc850)
    toks = let(toks, _split_zone)
    p = let(let(toks, _fields), _numbers)

    def fix_year(q: Column) -> Column:
        y = q["yy"]
        return q.withField("yy", F.when(y < 100, F.when(y > 68, y + 1900).otherwise(y + 2000)).otherwise(y))
    return let(p, fix_year)


def zone_seconds(tz: Column) -> Column:
    """Offset east of UTC in seconds; null for naive (missing, unknown, -0000)."""
    named = F.create_map(*[x for k, v in ZONE_OFFSETS.items() for x in (F.lit(k), F.lit(v))])
    v = F.coalesce(named[tz], tz.try_cast("int"))
    v = F.when((v == 0) & tz.startswith("-"), F.lit(None)).otherwise(v)
    a = F.abs(v)
    return F.when(v.isNotNull(), F.signum(v).cast("int") * ((a / 100).cast("int") * 3600 + (a % 100) * 60))


# the common RFC 5322 spelling ("[Www, ]d Mon yyyy hh:mm:ss +zzzz [anything]"):
# for these strings the lenient rules and a strict pattern agree, so they are
# parsed by generated code; everything else takes the general tokenizer
_STANDARD = (r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2}) ([A-Za-z]{3}) ([1-9]\d{3}) (\d{2}:\d{2}:\d{2}) "
             r"([+-](?:0\d|1[0-7])[0-5]\d)(?:\s.*)?$")


def _general_epoch(s: Column) -> Column:
    def epoch(p: Column) -> Column:
        # explicit +0000: the wall clock is read as UTC whatever the session zone
        local = F.format_string("%04d-%02d-%02d %02d:%02d:%02d +0000", p["yy"], p["mm"], p["dd"],
                                p["hh"], p["mi"], p["ss"])
        ts = F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss Z"))
        off = F.coalesce(zone_seconds(p["tz"]), F.lit(0))
        return F.when(p.isNotNull() & (p["yy"] >= 1) & (p["yy"] <= 9999),
                      F.unix_timestamp(ts).cast("double") - off)
    return let(mail_date_parts(s), epoch)


def mail_epoch(s: Column) -> Column:
    """Epoch seconds (UTC) of a mail date, null when unparsable."""
    v = F.coalesce(s, F.lit(""))
    # one match for all five fields; the tail is a line end that ``$`` leaves
    core = F.regexp_replace(v, _STANDARD + r"[\s\S]*", "$1 $2 $3 $4 $5")
    fast = F.unix_timestamp(F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm:ss Z"))).cast("double")
    return F.when(v.rlike(_STANDARD), fast).otherwise(_general_epoch(s))


def parse_mail_date(s: Column) -> Column:
    """B11 as TIMESTAMP (UTC)."""
    return F.timestamp_seconds(mail_epoch(s))


def date_to_utc_iso(s: Column) -> Column:
    """Mail date as ``yyyy-MM-ddTHH:mm:ss+00:00``; naive = UTC; bad = now."""
    ts = F.coalesce(parse_mail_date(s), F.date_trunc("second", F.current_timestamp()))
    # render the UTC wall clock independently of the session time zone
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
