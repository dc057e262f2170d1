"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
windows of the test items scans every document once.

Words are runs of digits, letters and non-ASCII characters after lower-casing
A-Z.  A window is 13 consecutive words of an item; a shorter item is one
window; an item without words has none.  Document words inside any occurrence
are hit.  Null texts have no words.  Null item ids are listed as ``null``.
Documents are judged row by row, so repeated rows get equal results and other
columns are never read.  An empty benchmark hits nothing.

The automaton runs over word numbers: words outside the benchmark are 0.  It
is built from a broadcast whose text (``max_bytes``) and windows
(``max_windows``) are checked; a larger benchmark is cut into blocks of items,
one automaton and one scan per block, with the hits carried along in the rows.
A longer item is cut too: its parts share twelve words, so no window is lost.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.common import read

WINDOW = 13
MAX_BYTES = 64 << 20
#: windows of a block: 250 000 of rare words (2 MB of text) took 285 MB of a Python worker
MAX_WINDOWS = 250_000

#: byte table: A-Z folded, every other ASCII byte outside words becomes a space
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: the same words in the original text, before folding
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")

HITS = "n_words bigint, words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """Automaton over the windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for window in windows_of(split_words(text), size):
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                owners.setdefault(key, set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(ids))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str) -> tuple[int, list[int], list[str]]:
        """Number of words, sorted indices of hit words, sorted items found."""
        words = split_words(text)
        if self.empty or not words:
            return len(words), [], []
        get = self.number.get
        numbers = tuple([get(w, 0) for w in words])
        if not any(numbers):
            return len(words), [], []
        hit, items = set(), set()
        for end, (length, ids) in self.automaton.iter(numbers):
            hit.update(range(end - length + 1, end + 1))
            items.update(ids)
        return len(words), sorted(hit), sorted(items)


def spans_of(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Code point spans, in the original text, of runs of hit words."""
    if not hit:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    last = None
    for i in hit:
        if last is not None and i == last + 1:
            out[-1] = (out[-1][0], places[i][1])
        else:
            out.append(places[i])
        last = i
    return out


_SCANNERS: dict[str, Scanner] = {}


def _scan_udf(items, size: int):
    """Arrow UDF for one broadcast block of items."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark_type = _parse_datatype_string(HITS)
    arrow_type = to_arrow_type(spark_type)
    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        if key not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[key] = Scanner(items.value, size)
        scan = _SCANNERS[key].scan
        rows = []
        for t in texts:
            text = t.as_py() or ""
            n, hit, ids = scan(text)
            rows.append({"n_words": n, "words": hit, "items": ids,
                         "spans": [{"start": a, "end": b} for a, b in spans_of(text, hit)]})
        return pa.array(rows, type=arrow_type)

    return F.arrow_udf(run, spark_type).asNondeterministic()


def _spans_udf():
    """Arrow UDF ``text, words -> spans`` of the words' places in the text."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string("array<struct<start:int,end:int>>")
    arrow = to_arrow_type(kind)

    def run(texts: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in spans_of(t.as_py() or "", w)]
                         for t, w in zip(texts, words.to_pylist())], type=arrow)

    return F.arrow_udf(run, kind)


def parts_of(text: str, size: int, max_windows: int) -> list[tuple[str, int]]:
    """Texts of at most ``max_windows`` windows each, which together are those of ``text``, and their number."""
    words = split_words(text)
    n = max(1, len(words) - size + 1) if words else 0
    if n <= max_windows:
        return [(text, n)]
    return [(b" ".join(words[i:i + max_windows + size - 1]).decode(), min(max_windows, n - i))
            for i in range(0, n, max_windows)]


def _blocks(benchmark: DataFrame, max_bytes: int, max_windows: int, size: int) -> list:
    """Broadcast blocks of items of at most ``max_windows`` windows, repeated
    ones counted, and ``max_bytes`` of text (a larger part of an item alone)."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"),
                            F.coalesce("text", F.lit("")).alias("t"))
    blocks: list[list] = [[]]
    room, free = max_bytes, max_windows
    for r in rows.toLocalIterator():
        for text, n in parts_of(r.t, size, max_windows):
            length = len(text.encode())
            if (length > room or n > free) and blocks[-1]:
                blocks[-1] = spark.sparkContext.broadcast(blocks[-1])
                blocks.append([])
                room, free = max_bytes, max_windows
            blocks[-1].append((r.i, text))
            room -= length
            free -= n
    blocks[-1] = spark.sparkContext.broadcast(blocks[-1])
    return blocks


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                   max_bytes: int = MAX_BYTES, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``hits`` (HITS) per row."""
    blocks = _blocks(benchmark, max_bytes, max_windows, size)
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    for k, block in enumerate(blocks):
        found = _scan_udf(block, size)(F.col("row").getField("text"))
        if k == 0:
            out = out.select("row", found.alias("hits"))
        else:  # each further block scans rows written down with the hits so far
            out = out.checkpoint().select("row", "hits", found.alias("more")).select("row", F.struct(
                F.col("hits.n_words").alias("n_words"),
                F.array_sort(F.array_union("hits.words", "more.words")).alias("words"),
                F.array_sort(F.array_union("hits.items", "more.items")).alias("items")).alias("hits"))
    if len(blocks) > 1:  # words of several blocks may meet
        spans = _spans_udf()(F.col("row").getField("text"), F.col("hits.words"))
        out = out.select("row", F.col("hits").withField("spans", spans).alias("hits"))
    return out


def contaminated(hits: Column) -> Column:
    """A twentieth of the words, and at least one, inside benchmark windows."""
    n_hit = F.size(hits["words"])
    return (n_hit > 0) & (F.lit(20) * n_hit >= hits["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    kept = scan_documents(docs, benchmark).filter(~contaminated(F.col("hits")))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan_documents(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hits = F.col("hits")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), hits["n_words"].alias("n_words"),
        F.size(hits["words"]).cast("bigint").alias("n_hit"), F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hits["items"]), ","), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(len(ws), 13) AS size, array_to_string(ws[i:i + 12], ' ') AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
dw AS (SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
       FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
h AS (SELECT rid, i, size, item FROM dw JOIN p USING (size, win)),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS q FROM h) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s
       FROM h GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
