"""Product codes of vectors, trained in integers, with Orchard's search.

A vector's components become ``floor(256 * x)`` and the vector is cut into
``parts`` equal parts.  Every part position has a codebook that starts as that
part of the vectors with the smallest ids.  A round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the floored mean of its parts; unused entries stay.

Nearest entries are found by Orchard's method.  Every entry has the list of
all entries sorted by their distance from it.  A search walks the list of the
best entry so far, measures only entries not yet marked as visited, jumps to
the list of an entry that is nearer, and stops where the list goes beyond
twice the current distance: by the triangle inequality nothing further can be
nearer or as near.  Searches of a batch run side by side in numpy.

A round is one scan: tasks sum their parts per entry, Spark adds these sums,
and the driver sees ``parts * entries`` rows at any input size.  Codebooks and
lists (``parts * entries ** 2`` numbers) travel with the tasks; at most 256
entries are allowed.

Rows whose vector is null or holds null or non-finite components are dropped.
The vector of the smallest id with a positive multiple of ``parts`` as its
length sets the length; vectors of other lengths come back with null code and
error and belong to no label's sum.  Scaled components saturate at 2**20 in
size, so all sums are exact.  Null ids come last, equal ids go by vector, and
repeated rows each count.  With fewer than ``entries`` vectors the codebook is
as short.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
MOST = 1 << 20
#: searches that run side by side
LANES = 16_384


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * float(SCALE)), -MOST, MOST).astype(np.int64)


class Lists:
    """Codebook of one part position with its sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, None, :] - entries[None, :, :]
        far = (gap * gap).sum(axis=2)
        self.order = np.argsort(far, axis=1, kind="stable")
        self.far = np.take_along_axis(far, self.order, axis=1)
        # where a search starts: the entry next to it by first component
        self.by_first = np.argsort(entries[:, 0], kind="stable")
        self.first = entries[self.by_first, 0]

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance) of each row of ``q``, and the
        number of distances measured."""
        n, k = len(q), len(self.entries)
        at = self.by_first[np.minimum(np.searchsorted(self.first, q[:, 0]), k - 1)]
        gap = q - self.entries[at]
        dist = (gap * gap).sum(axis=1)
        best, place = at.copy(), np.zeros(n, dtype=np.int64)
        visited = np.zeros((n, k), dtype=bool)
        visited[np.arange(n), at] = True
        measured, live = n, np.arange(n)
        while len(live):
            live = live[self.far[at[live], place[live]] <= 4 * dist[live]]
            near = self.order[at[live], place[live]]
            place[live] += 1
            fresh = ~visited[live, near]
            row, near = live[fresh], near[fresh]
            visited[row, near] = True
            measured += len(row)
            gap = q[row] - self.entries[near]
            d = (gap * gap).sum(axis=1)
            tie = (d == dist[row]) & (near < best[row])
            best[row[tie]] = near[tie]
            closer = d < dist[row]
            row, near = row[closer], near[closer]
            at[row], best[row], dist[row], place[row] = near, near, d[closer], 0
            live = live[place[live] < k]
        return best, dist, measured


def assign(matrix: np.ndarray, lists: list[Lists]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of each row's parts."""
    width = matrix.shape[1] // len(lists)
    codes = np.empty((len(matrix), len(lists)), dtype=np.int64)
    dist = np.empty_like(codes)
    for p, part in enumerate(lists):
        for a in range(0, len(matrix), LANES):
            codes[a:a + LANES, p], dist[a:a + LANES, p], _ = part.search(matrix[a:a + LANES, p * width:(p + 1) * width])
    return codes, dist


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width)


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that are kept."""
    return vectors.select(vectors["vec_id"], vectors["label"], vectors["embedding"].cast("array<double>").alias("v")).filter(
        "v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")


def _sums(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """[part, entry, (count, component sums)] of the parts assigned to each entry."""
    parts, entries, width = books.shape
    dim = parts * width
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        lists = [Lists(b) for b in books]
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch.column("v"), dim)
            codes, _ = assign(rows, lists)
            for p in range(parts):
                part = np.concatenate([np.ones((len(rows), 1), dtype=np.int64), rows[:, p * width:(p + 1) * width]], axis=1)
                np.add.at(total[p], codes[:, p], part)
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([
            pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(total[p, e, 0]),
            pa.array(list(total[p, e, 1:]), pa.list_(pa.int64()))], schema=schema)

    found = kept.select("v").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
    summed = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect()
    out = np.zeros((parts, entries, width + 1), dtype=np.int64)
    for r in summed:
        out[r.part, r.entry] = [r.n, *r.s]
    return out


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, component] of ``finite_vectors``; no entries
    where no vector has a fitting length."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    fit = kept.filter(f"size(v) > 0 AND size(v) % {parts} = 0")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = fit.select("vec_id", "v").orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    dim = len(first[0].v)
    fit = fit.filter(F.size("v") == dim)
    seeds = np.array([r.v for r in fit.select("vec_id", "v").orderBy(*order).limit(entries).collect()])
    books = np.ascontiguousarray(scaled(seeds).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        found = _sums(fit, books)
        used = found[:, :, 0] > 0
        books = np.where(used[:, :, None], found[:, :, 1:] // np.maximum(found[:, :, :1], 1), books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of ``finite_vectors``."""
    parts, entries, width = books.shape
    dim = parts * width
    label = kept.schema["label"].dataType.simpleString()
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches):
        lists = [Lists(b) for b in books] if entries else []
        for batch in batches:
            v = batch.column("v")
            fits = v.value_lengths().to_numpy() == dim if entries else np.zeros(len(v), dtype=bool)
            codes, dist = assign(_matrix(v.filter(pa.array(fits)), dim), lists) if fits.any() else (np.zeros((0, parts)), np.zeros((0, parts)))
            digits = codes.astype(np.uint8).tobytes().hex()
            code, error = np.full(len(v), None, dtype=object), np.zeros(len(v), dtype=np.int64)
            code[fits] = [digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            error[fits] = dist.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()),
                                              pa.array(error, mask=~fits)], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id {kind}, label {label}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_orchard_codes(vectors: DataFrame) -> DataFrame:
    kept = finite_vectors(vectors)
    books = train(kept)
    coded = encode(kept, books).checkpoint()
    # a label's sum is one row; where labels are many, a hot label's rows can be split
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(
        F.col("label").alias("sum_label"), F.least("total", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint").alias("total"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["sum_label"])).select(
        "vec_id", "code", "error", F.when(F.col("error").isNotNull(), F.col("total")).alias("label_error"),
        F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of round ``k``: assignment to book k, then book k + 1."""
    return f"""
near{k} AS (
  SELECT vec_id, p.part, min(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + entry) AS m
  FROM parts p JOIN book{k} b ON p.part = b.part GROUP BY vec_id, p.part),
mean{k} AS (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT part, m % {ENTRIES} AS entry, i, sum(v[i]) AS s, count(*) AS n
    FROM near{k} JOIN parts USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL)
  GROUP BY part, entry),
book{k + 1} AS (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)),"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id) - 1 AS nth
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, nth, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v
  FROM kept, (SELECT unnest(range({PARTS})) AS part)),
book0 AS (SELECT part, nth AS entry, v FROM parts WHERE nth < {ENTRIES}),{"".join(_round(k) for k in range(ROUNDS))}
last AS (
  SELECT vec_id, p.part, min(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + entry) AS m
  FROM parts p JOIN book{ROUNDS} b ON p.part = b.part GROUP BY vec_id, p.part),
coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(CAST(m % {ENTRIES} AS BIGINT))), 2, '0'), '' ORDER BY part) AS code,
         CAST(sum(m // {ENTRIES}) AS BIGINT) AS error
  FROM last GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
