"""Resampling of documents towards a target distribution.

Features of a text are its runs of 1 to ``max_words`` consecutive words, and a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``.  A bucket's
gain is the logarithm of how much more frequent it is in the target than in
the documents; a document's weight is the sum of gains over its features.
Adding Gumbel noise drawn from a hash of the id and taking the highest scores
draws without replacement in proportion to the weights.

Buckets come from a head and a tail.  The head is broadcast: the CRC state of
every frequent word, and the bucket of every frequent pair.  A run that starts
with a head word goes on from its state; a feature outside the head takes its
CRC directly.  Both give the same numbers, so the totals are exact whatever
the head holds, and the head may be found by lossy counting: a task forgets
its rarest words when it holds ``TASK_WORDS`` of them, and reports those that
make at least one in ``4 * head`` of its words.  The head has at most ``head``
words and as many pairs, of at most ``HEAD_BYTES`` bytes each.

Every text is cut into words twice (head, then buckets).  Its buckets with
counts are written to the shared folder, at most ``buckets`` a text, and totals
and weights are taken from there.  Drawn documents are numbered over range
partitions, never in one window.

Null texts have no words; they weigh 0 and are never drawn.  A null id hashes
like an empty string and comes after the others.  Repeated rows count and are
drawn one by one.  Without target texts, or on an empty table, gains follow
the same formula.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import read
from mailspark.operators.numbering import row_number_by
from mailspark.session import scratch_dir

BUCKETS = 10_000
MAX_WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
HEAD = 16_384
HEAD_BYTES = 64
TASK_WORDS = 400_000
TASK_SHIFT = 36

#: A-Z folded, everything that is not of a word blanked; all bytes beyond ASCII are of words
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _forget(counts: Counter, most: int) -> Counter:
    floor = 1
    while len(counts) > most:
        counts = Counter({w: n for w, n in counts.items() if n > floor})
        floor *= 2
    return counts


def frequent(texts: DataFrame, max_words: int = MAX_WORDS, head: int = HEAD) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """CRC states of frequent words, and of frequent pairs where features
    have more than one word."""
    schema = pa.schema([("size", pa.int32()), ("run", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts, total = [Counter() for _ in range(min(2, max_words))], 0
        for batch in batches:
            for text in batch.column("text"):
                words = words_of(text.as_py())
                total += len(words)
                counts[0].update(words)
                if max_words > 1:
                    counts[1].update(zip(words, words[1:]))
                for k, c in enumerate(counts):
                    if len(c) > TASK_WORDS:
                        counts[k] = _forget(c, TASK_WORDS // 2)
        for k, c in enumerate(counts):
            rows = [(b" ".join(w) if k else w, n) for w, n in c.items() if 4 * head * n >= total]
            rows = [(w, n) for w, n in rows if len(w) <= HEAD_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([k + 1] * len(rows), pa.int32()), pa.array([w for w, _ in rows], pa.binary()),
                                              pa.array([n for _, n in rows], pa.int64())], schema=schema)

    found = texts.select("text").mapInArrow(run, "size int, run binary, n bigint").groupBy("size", "run").agg(F.sum("n").alias("n")).checkpoint()
    words, pairs = ({bytes(r.run): crc32(r.run) for r in found.filter(f"size = {k}").orderBy(F.desc("n"), "run").limit(head).collect()}
                    for k in (1, 2))
    return words, pairs


def feature_buckets(words: list[bytes], states: dict[bytes, int], pairs: dict[bytes, int], max_words: int,
                    buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the distinct features; a bucket may occur again."""
    seen = Counter(words)
    found = [crc32(w) if s is None else s for w, s in zip(seen, map(states.get, seen))]
    times = list(seen.values())
    for size in range(2, max_words + 1):
        runs = Counter(zip(*(words[k:] for k in range(size))))
        for r, n in runs.items():
            state = pairs.get(b" ".join(r)) if size == 2 else None
            if state is None:
                state = states.get(r[0])
                state = crc32(b" " + b" ".join(r[1:]), crc32(r[0]) if state is None else state)
            found.append(state)
            times.append(n)
    return np.array(found, dtype=np.int64) % buckets, np.array(times, dtype=np.int64)


COUNTED = "row bigint, doc_id bigint, n_words bigint, n_features bigint, buckets binary, counts binary"


def count_features(texts: DataFrame, path: str, states, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """COUNTED rows of ``texts(doc_id, text)``, written to ``path``."""
    schema = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in COUNTED.split(", ")])

    def run(batches):
        words_at, pairs = states.value
        row = TaskContext.get().partitionId() << TASK_SHIFT
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                at, n = feature_buckets(words, words_at, pairs, max_words, buckets)
                if len(at) > buckets:
                    n = np.bincount(at, weights=n, minlength=buckets).astype(np.int64)
                    at = np.flatnonzero(n)
                    n = n[at]
                out.append((row, doc, len(words), int(n.sum()), at.astype("<u4").tobytes(), n.astype("<i8").tobytes()))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), schema.types)]
                                             if out else [pa.array([], t) for t in schema.types], schema=schema)

    # buckets and counts are mostly zero bytes
    texts.mapInArrow(run, COUNTED).write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(COUNTED).parquet(path)


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, count) of all rows of a batch, and where each row ends."""
    at = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u4")
    n = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i8")
    ends = np.cumsum([len(v.as_buffer()) // 4 for v in batch.column("buckets")])
    return at, n, ends


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Exact number of features in each bucket."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            at, n, _ = _joined(batch)
            np.add.at(total, at, n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(counted: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score)."""
    def run(batches):
        for batch in batches:
            at, n, ends = _joined(batch)
            sums = np.concatenate([[0], np.cumsum(gain[at] * n)])
            ends = np.concatenate([[0], ends]).astype(np.int64)
            weight = sums[ends[1:]] - sums[ends[:-1]]
            score = weight + np.array([noise(d, seed) for d in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_words", "n_features")),
                                              pa.array(weight), pa.array(score)],
                                             names=["row", "doc_id", "n_words", "n_features", "weight", "score"])

    return counted.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: str = SEED, head: int = HEAD) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of
    ``docs(doc_id, text)``; ``rank`` is null where it is not drawn."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    wanted = target.select(F.lit(None).cast("bigint").alias("doc_id"), target["text"].alias("text"))
    # at most 2 * head short strings
    states = spark.sparkContext.broadcast(frequent(texts.unionByName(wanted), max_words, head))
    counted = count_features(texts, scratch_dir(spark, "resample-source"), states, max_words, buckets)
    aimed = count_features(wanted, scratch_dir(spark, "resample-target"), states, max_words, buckets)
    gain = gains(bucket_totals(counted, buckets), bucket_totals(aimed, buckets))
    rows = weigh(counted, gain, seed).checkpoint()
    fit = rows.filter(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]
    ranked = row_number_by(fit, [], order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
words AS MATERIALIZED (
  SELECT side, doc_id, w, count(*) AS n FROM (
    SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts)
  GROUP BY ALL),
coded AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(0, length(x), 2), lambda i: CAST('0x' || x[i + 1:i + 2] AS BIGINT)),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)), crc),
counted AS MATERIALIZED (SELECT side, doc_id, bucket, sum(n) AS n FROM words JOIN coded USING (w) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM counted),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(g.t AS DOUBLE) + 1) * (sums.s + {BUCKETS}) / ((CAST(g.s AS DOUBLE) + 1) * (sums.t + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
        FROM counted GROUP BY bucket) g, sums),
weighed AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= {PERCENT} * n // 100 THEN nth END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
