"""Quality rules, line first: every line is judged by punctuation, navigation
and boilerplate rules, failing lines are removed, and documents that lose too
much of their text are rejected.

Words are runs of characters other than space and \\x09-\\x0D.  Null texts count
as empty: no words, so ``base_failed`` and not kept.  Rows are judged one by
one: repeated rows get equal verdicts, ids are never looked at, other columns
pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.common import arrow_struct

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 0.20
#: a document goes when more than this part of its word characters is in failing lines
MAX_LOST = 0.5

# line rules; the same values stand in ORACLE
#: punctuation: symbols make a fifth of the line, or over half of its words shout
MAX_SYMBOLS = 5
SHOUTS = tuple(a + b for a in (b"!!", b"??", b"!?", b"?!") for b in (b"", b".", b","))
#: navigation: three or more of these stand alone, a sixth of the words at least
SEPARATORS = frozenset(s.encode() for s in ("|", ">", ">>", "/", "\u00bb", "\u00b7", "\u2022"))
MIN_SEPARATORS, SEPARATOR_SHARE = 3, 6
#: boilerplate, in lines of at most BOILERPLATE_WORDS words
BOILERPLATE = (b"all rights reserved", b"privacy policy", b"terms of use", b"terms of service", b"cookie policy",
               b"we use cookies", b"accept cookies", b"enable javascript", b"subscribe to our newsletter",
               b"sign up for our", b"click here to", b"skip to content", b"skip to main content",
               b"share on facebook", b"share on twitter", b"lorem ipsum", b"back to top")
BOILERPLATE_WORDS = 30

SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, n_lines_removed bigint, lost_chars bigint, clean_text string")


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    ones = b"\x01" * WINDOW
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i:i + WINDOW] = ones
            hit[j:j + WINDOW] = ones
    return hit.count(1)


def _chars(raw: bytes) -> int:
    """Code points outside white space."""
    return len(raw.translate(None, SPACES).decode())


def line_fails(line: bytes) -> bool:
    """Whether a line with words breaks a punctuation, navigation or boilerplate rule."""
    n_symbols = len(line) - len(line.translate(None, SYMBOLS))
    if n_symbols >= 3 and n_symbols * MAX_SYMBOLS >= _chars(line):
        return True
    words = line.split()
    shouts = sum(w.endswith(SHOUTS) for w in words)
    if shouts >= 3 and 2 * shouts > len(words):
        return True
    separators = sum(w in SEPARATORS for w in words)
    if separators >= MIN_SEPARATORS and separators * SEPARATOR_SHARE >= len(words):
        return True
    if len(words) <= BOILERPLATE_WORDS:
        low = line.lower()
        return any(b in low for b in BOILERPLATE)
    return False


def _suspect(raw: bytes, words: list[bytes], n_symbols: int) -> bool:
    """False only where no line can fail; most texts end here."""
    low = raw.lower()
    return (n_symbols >= 3 or any(s in raw for s in SHOUTS[::3]) or not SEPARATORS.isdisjoint(words)
            or any(b in low for b in BOILERPLATE))


def judge(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    chars = _chars(raw)
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = removed = lost = 0
    out = []
    suspect = _suspect(raw, words, n_symbols)
    for line in lines:
        if not line.strip(SPACES):
            out.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if suspect and line_fails(line):
            removed += 1
            lost += _chars(line)
        else:
            out.append(line)
    repeated = _repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > 100 * MAX_REPEATED * n
    kept = not failed and lost <= MAX_LOST * chars
    clean = b"\n".join(out).decode() if removed else text
    return n, chars, n_symbols, dup, repeated, failed, kept, removed, lost, clean


def line_quality(text: str | Column) -> Column:
    """Struct column with counts, verdict and cleaned text of a text column."""
    return arrow_struct(judge, SCHEMA)(F.col(text) if isinstance(text, str) else text)


def clean_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass, with failing lines removed from ``text`` and
    ``n_chars`` counted anew; all columns stay as they are named."""
    judged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), line_quality(docs["text"]).alias("q"))
    kept = judged.filter("q.kept")
    return kept.select(*[
        F.col("q.clean_text").alias(c) if c == "text"
        else F.length("q.clean_text").cast("bigint").alias(c) if c == "n_chars"
        else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_line_quality(docs: DataFrame) -> DataFrame:
    q = docs.select(docs["doc_id"], line_quality(docs["text"]).alias("q"))
    return q.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
                    "q.base_failed", "q.kept", "q.n_lines_removed", "q.lost_chars")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
win AS (SELECT rid, pos, word || ' ' || lead(word, 1) OVER r || ' ' || lead(word, 2) OVER r || ' '
               || lead(word, 3) OVER r || ' ' || lead(word, 4) OVER r AS win
        FROM w WINDOW r AS (PARTITION BY rid ORDER BY pos)),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS c FROM win WHERE win IS NOT NULL)
        WHERE c > 1),
repw AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
         FROM (SELECT rid, unnest(range(pos, pos + 5)) AS p FROM rep) GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
      FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d)),
ln AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth,
              length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
              length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS sym,
              regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
              translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (SELECT *, (sym >= 3 AND sym * 5 >= chars) OR (shouts >= 3 AND 2 * shouts > nw)
       OR (seps >= 3 AND seps * 6 >= nw)
       OR (nw <= 30 AND len(list_filter(['all rights reserved', 'privacy policy', 'terms of use', 'terms of service',
           'cookie policy', 'we use cookies', 'accept cookies', 'enable javascript', 'subscribe to our newsletter',
           'sign up for our', 'click here to', 'skip to content', 'skip to main content', 'share on facebook',
           'share on twitter', 'lorem ipsum', 'back to top'], lambda b: contains(low, b))) > 0)
       AS fails FROM (SELECT *, len(ws) AS nw,
           len(list_filter(ws, lambda w: regexp_matches(w, '[!?]{2}[.,]?$'))) AS shouts,
           len(list_filter(ws, lambda w: w IN ('|', '>', '>>', '/', '»', '·', '•'))) AS seps FROM ln)),
la AS (SELECT rid, sum((nth > 1)::BIGINT) AS n_dup_lines, sum(fails::BIGINT) AS n_lines_removed,
              sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost_chars FROM judged GROUP BY rid),
b AS (SELECT rid, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols FROM d),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
             coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(lost_chars, 0)::BIGINT AS lost_chars
      FROM b LEFT JOIN la USING (rid) LEFT JOIN repw USING (rid))
SELECT *, NOT base_failed AND lost_chars * 2 <= word_chars AS kept FROM j
"""
