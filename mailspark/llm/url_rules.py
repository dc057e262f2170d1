"""URL filter: pattern rules indexed by their rarest literal token.

Two kinds of rules share one index.  Site rules are (host, path prefix); the
longest that fits decides.  Pattern rules are regular expressions over
``host + path``; any that matches blocks, where no site rule decides.  Every
rule carries literal tokens that each URL it fits must contain; it is filed
under the one that is rarest among the tokens of the distinct URLs.  The
tokens of a URL fetch the candidate rules, and only those run their regular
expression.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  Null URLs and
URLs without ``://`` have neither, meet no rule and are allowed.  Equal URLs
are judged once; every row of ``pages`` comes back, repeated ones too, and
extra columns are never read.  Only DataFrame operations run here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import ascii_lower, read

#: rules are broadcast up to this number, joined by token beyond it
BROADCAST_RULES = 100_000
TOKEN = "[a-z0-9]+"

#: (host, path, verdict)
SITE_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: (name, regular expression over host + path, A-Z folded, literal tokens)
PATTERN_RULES = [
    ("ads-host", r"^([^/]*[.-])?ads[.-]", ["ads"]),
    ("tracker", r"^[^/]*\btrack\b", ["track"]),
    ("pills", r"^[^/]*\b(cheap|online)-pills\b", ["pills"]),
    ("bets", r"^[^/]*\b(free|best)-bets\b", ["bets"]),
    ("casino", r"^[^/]*\bcasino\b", ["casino"]),
    ("login", r"/login(/|$)", ["login"]),
    ("cart", r"/cart(/|$)", ["cart"]),
    ("archive", r"\.zip$", ["zip"]),
    ("installer", r"\.exe$", ["exe"]),
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _literal_tokens(text: str, open_end: bool) -> list[str]:
    """Whole tokens of a literal; the last may run on where the end is open."""
    found = [(m.group(), m.end()) for m in re.finditer(TOKEN, text)]
    return [t for t, end in found if not (open_end and end == len(text))]


def site_rules(rules: list[tuple[str, str, str]]) -> list[tuple]:
    out = []
    for host, path, verdict in rules:
        tokens = _literal_tokens(host + path.lower(), True)
        pattern = r"(?s)^([^/]*\.)?" + re.escape(host) + re.escape(path)
        out.append((host + path, "site", pattern, verdict, tokens))
    return out


def pattern_rules(rules: list[tuple[str, str, list[str]]]) -> list[tuple]:
    return [(name, "pattern", "(?s)" + pattern, "block", tokens) for name, pattern, tokens in rules]


def rule_table(spark: SparkSession, site=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """(rule, kind, pattern, verdict, tokens).  A pattern rule lists tokens
    that all its matches hold; a rule without any is tried on every URL."""
    rows = [F.struct(*[F.lit(v).alias(c) for v, c in zip(r[:4], ("rule", "kind", "pattern", "verdict"))],
                     F.array(*map(F.lit, r[4])).cast("array<string>").alias("tokens"))
            for r in site_rules(site) + pattern_rules(patterns)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _token_rows(urls: DataFrame) -> DataFrame:
    """Distinct tokens of each distinct URL; the empty token is in all."""
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(
        ascii_lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), 1)))
    return urls.select("url", "host", "path", F.explode(tokens).alias("token"))


def index_rules(rules: DataFrame, token_rows: DataFrame, small: bool) -> DataFrame:
    """Rules with the ``token`` they are filed under: the one found in the
    fewest URLs, the longest and first among equals."""
    listed = rules.select("rule", "kind", "pattern", "verdict",
                          F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    names = listed.select("token").distinct()
    counts = token_rows.select("token").join(F.broadcast(names) if small else names, "token").groupBy("token").count()
    best = listed.join(counts, "token", "left").groupBy("rule", "kind", "pattern", "verdict").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")).alias("best"))
    return best.select("rule", "kind", "pattern", "verdict", F.col("best.token").alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for every row of ``pages``."""
    small = rules.count() <= BROADCAST_RULES
    rows = pages.select(pages["page_id"], F.coalesce(pages["url"], F.lit("")).alias("url"))
    urls = rows.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = _token_rows(urls.filter("host <> '' OR path <> ''"))
    index = index_rules(rules, tokens, small)
    # site paths are case sensitive, pattern rules read a folded path
    text = F.when(F.col("kind") == "site", F.concat("host", "path")).otherwise(ascii_lower(F.concat("host", "path")))
    hits = tokens.join(F.broadcast(index) if small else index, "token").filter(F.regexp_like(text, F.col("pattern")))
    site, other = F.col("kind") == "site", F.col("kind") == "pattern"
    # longest site rule; of equally long ones the blocking, then the first
    site_rank = F.struct(-F.length("rule"), F.when(F.col("verdict") == "block", 0).otherwise(1), F.col("rule"), F.col("verdict"))
    best = hits.groupBy("url").agg(
        F.min(F.when(site, site_rank)).alias("site"), F.min(F.when(other, F.col("rule"))).alias("pattern"))
    best = best.select("url", F.col("site.rule").alias("rule"), F.col("site.verdict").alias("site_verdict"), "pattern")
    judged = rows.join(best, "url", "left")
    verdict = F.coalesce("site_verdict", F.when(F.col("pattern").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
                         verdict.alias("verdict"), "pattern")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), rule_table(spark))


def _oracle() -> str:
    site = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in SITE_RULES)
    pats = ", ".join(f"('{n}', '{p}')" for n, p, _ in PATTERN_RULES)
    return rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id,
       translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s(h, pre, v) AS (VALUES {site}),
r(name, pat) AS (VALUES {pats}),
fit AS (SELECT rid, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS v
        FROM p, s WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY rid),
m AS (SELECT rid, min(name) AS pattern FROM p, r
      WHERE regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pat)
        AND (host <> '' OR path <> '') GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM p LEFT JOIN fit USING (rid) LEFT JOIN m USING (rid)
"""


ORACLE = _oracle()
