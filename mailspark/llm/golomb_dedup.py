"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when their UTF-8 bytes are equal after deleting ASCII white
space.  Of equal texts the row with the most code points in the original text
stays, then the smallest id.

1. *Blocks.*  A task cuts its rows into blocks and writes them with the SHA-256
   of the normalised text; the first row of a block also carries the block's
   sorted distinct 64-bit hashes, and every row its place among these.
2. *Send.*  A block sends each owner of a hash range its fingerprints there:
   the leading bits of the hashes, as gaps in a Golomb code with a power of two
   as parameter.  Enough bits are kept for one false match in about 2 ** SLACK
   rows.  A hash goes out once a block, however many rows have it.
3. *Reply.*  An owner decodes what it got, and answers each message with a
   bitmap: which of its fingerprints came more than once.
4. *Verify.*  A row is a suspect if its bit is set or its hash is repeated in
   its own block.  All other rows are unique and never move.  Suspects are
   grouped by their bytes, with one row per block task and text after the
   partial aggregate, so a hot text is never gathered.

Bitmaps meet the blocks by a broadcast of at most ``BITMAP_BYTES``; where there
are more, ranges of blocks are flagged one after another, each with a bitmap
table within the bound, so texts are shuffled only where suspect at any size.
Blocks are Parquet files under ``spark.checkpoint.dir``: a lost executor costs
the tasks it ran, and a block's cut never changes.

Null texts count as empty.  Null ids come after all others.  Equal rows (same
id, length and text) are told apart by their place: one of them stays.  Very
long texts make a block of their own.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailspark.llm.common import NULL_ID
from mailspark.session import scratch_dir

SPACE = b" \t\n\x0b\x0c\r"
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 24 << 20
#: hashes that one owner gets on average, at most
OWNER_HASHES = 16 << 20
#: fingerprint bits beyond those that number the rows
SLACK = 10
MOST_BITS = 46
BITMAP_BYTES = 32 << 20
#: rows of a task are numbered below this bit
TASK_SHIFT = 36

BLOCKS = ("row bigint, block bigint, place int, here boolean, doc_id bigint, n_chars bigint, mark bigint, sha binary, "
          "norm binary, hashes binary")


def golomb_encode(gaps: np.ndarray) -> bytes:
    """Golomb code of non-negative gaps: count, parameter, unary part, binary part."""
    n = len(gaps)
    mean = int(gaps.max()) if n == 1 else int(gaps.mean(dtype=np.float64))
    low = max(0, int(mean * 0.69).bit_length() - 1)
    high = (gaps >> np.uint64(low)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.ones(int(ends[-1]) if n else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    bits = (gaps[:, None] >> np.arange(low, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
    return struct.pack("<IBI", n, low, len(unary)) + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n, low, length = struct.unpack_from("<IBI", data)
    at = struct.calcsize("<IBI")
    stop = at + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(data, np.uint8, stop - at, at), count=length)
    high = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, stop), count=n * low).reshape(n, low)
    powers = np.uint64(1) << np.arange(low, dtype=np.uint64)
    return (high.astype(np.uint64) << np.uint64(low)) + (bits * powers).sum(axis=1, dtype=np.uint64)


def write_blocks(docs: DataFrame, path: str, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> None:
    """BLOCKS rows of ``docs(doc_id, text)``."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    schema = pa.schema([(f.split()[0], k) for f, k in zip(BLOCKS.split(", "), kinds)])

    def run(batches):
        from xxhash import xxh64_intdigest

        base, done = TaskContext.get().partitionId() << TASK_SHIFT, 0
        ids, chars, marks, norms, held = [], [], [], [], 0

        def close():
            shas = [hashlib.sha256(t).digest() for t in norms]
            h = np.frombuffer(b"".join([s[:8] for s in shas]), ">u8").astype("<u8")
            distinct, place, times = np.unique(h, return_inverse=True, return_counts=True)
            n = len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array(np.arange(n) + base + done), pa.array(np.full(n, base + done)), pa.array(place, pa.int32()),
                pa.array(times[place] > 1), pa.array(ids, pa.int64()), pa.array(chars, pa.int64()),
                pa.array(np.array(marks, dtype=np.uint64).view(np.int64)), pa.array(shas, pa.binary()),
                pa.array(norms, pa.binary()), pa.array([distinct.tobytes()] + [None] * (n - 1), pa.binary())], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                raw = text.encode()
                ids.append(doc)
                chars.append(len(text))
                marks.append(xxh64_intdigest(raw))
                norms.append(raw.translate(None, SPACE))
                held += len(norms[-1])
                if held >= block_bytes or len(ids) >= block_rows:
                    yield close()
                    done += len(ids)
                    ids, chars, marks, norms, held = [], [], [], [], 0
        if ids:
            yield close()

    docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, BLOCKS).write.parquet(path)


def bitmaps(rows: DataFrame, n_rows: int, owners: int | None = None, slack: int = SLACK) -> DataFrame:
    """(block, bits): per block the bitmap over its distinct hashes."""
    width = min(MOST_BITS, max(1, n_rows).bit_length() + slack)
    spark = rows.sparkSession
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // OWNER_HASHES))
    owners = min(owners, 1 << min(width, 63 - MOST_BITS))
    starts = np.array([-(-(o << width) // owners) for o in range(owners + 1)], dtype=np.uint64)

    def send(batches):
        for batch in batches:
            out = []
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("hashes")):
                prints = np.frombuffer(raw.as_py(), "<u8") >> np.uint64(64 - width)
                cut = np.searchsorted(prints, starts)
                for o in np.flatnonzero(np.diff(cut)).tolist():
                    part = prints[cut[o]:cut[o + 1]]
                    out.append((o, block, int(cut[o]), golomb_encode(np.diff(part, prepend=starts[o]))))
            yield pa.RecordBatch.from_pylist([dict(zip(("owner", "block", "first", "message"), r)) for r in out], schema=pa.schema(
                [("owner", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("message", pa.binary())]))

    def own(table: pa.Table) -> pa.Table:
        # counted from the owner's start: gaps add up to places in its range
        parts = [np.cumsum(golomb_decode(m.as_py()), dtype=np.uint64) for m in table.column("message")]
        _, place, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = (times > 1)[place]
        ends = np.cumsum([len(p) for p in parts])
        bits = [np.packbits(again[b - len(p):b], bitorder="little").tobytes() for p, b in zip(parts, ends)]
        return pa.table([table.column("block"), table.column("first"), pa.array([len(p) for p in parts], pa.int32()),
                         pa.array(bits, pa.binary())], names=["block", "first", "n", "bits"])

    def gather(table: pa.Table) -> pa.Table:
        replies = sorted(zip(*(table.column(c).to_pylist() for c in ("first", "n", "bits"))))
        whole = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n, bitorder="little") for _, n, b in replies])
        return pa.table([table.column("block")[:1], pa.array([np.packbits(whole, bitorder="little").tobytes()], pa.binary())],
                        names=["block", "bits"])

    sent = rows.filter("hashes IS NOT NULL").select("block", "hashes").mapInArrow(
        send, "owner int, block bigint, first bigint, message binary")
    replies = sent.groupBy("owner").applyInArrow(own, "block bigint, first bigint, n int, bits binary")
    return replies.groupBy("block").applyInArrow(gather, "block bigint, bits binary")


def _flag(rows: DataFrame, bits: DataFrame) -> DataFrame:
    byte = F.conv(F.hex(F.expr("substring(bits, place div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, place % 8)")) != 0
    return rows.join(F.broadcast(bits), "block").withColumn("suspect", F.col("here") | bit).select(
        "row", "doc_id", "n_chars", "mark", "sha", "suspect", F.when(F.col("suspect"), F.col("norm")).alias("norm"))


def flagged(spark: SparkSession, rows: DataFrame, bits: DataFrame, bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """Rows with ``suspect``, and their bytes where they are; bitmaps are
    broadcast within ``bitmap_bytes``, by ranges of blocks where there are more."""
    total, most = bits.agg(F.sum(F.length("bits")), F.max(F.length("bits"))).first()
    if (total or 0) <= bitmap_bytes:
        return _flag(rows, bits)
    ranges = -(-2 * total // bitmap_bytes)
    marks = bits.agg(F.percentile_approx("block", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("m")).first().m
    path = scratch_dir(spark, "dedup-flags")
    for low, high in zip([None, *sorted(set(marks))], [*sorted(set(marks)), None]):
        inside = F.lit(True)
        if low is not None:
            inside &= F.col("block") > low
        if high is not None:
            inside &= F.col("block") <= high
        _flag(rows.filter(inside), bits.filter(inside)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def exact_duplicates(docs: DataFrame, block_rows: int = BLOCK_ROWS, owners: int | None = None, slack: int = SLACK,
                     bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """(doc_id, mark, sha, keep_id, group_size, kept) of every row of
    ``docs(doc_id, text)``; ``mark`` is the XXH64 of the original text."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "dedup-blocks")
    write_blocks(docs, path, block_rows)
    rows = spark.read.schema(BLOCKS).parquet(path)
    found = flagged(spark, rows, bitmaps(rows, rows.count(), owners, slack).checkpoint(), bitmap_bytes)
    best = F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row")
    groups = found.filter("suspect").groupBy("sha", "norm").agg(F.count("*").alias("group_size"), F.min(best).alias("best")) \
        .select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")).checkpoint()
    if groups.groupBy("sha").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two different texts have one SHA-256")
    single = found.filter("NOT suspect").select(
        "doc_id", "mark", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    grouped = found.filter("suspect").select("row", "doc_id", "mark", "sha").join(groups, "sha").select(
        "doc_id", "mark", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    return single.unionByName(grouped)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, all columns."""
    kept = exact_duplicates(docs).filter("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "mark")
    mark = _xxh64(docs["text"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NULL_ID)).alias("id"), mark.alias("mark"))
    # equal rows: as many as stay (one), whichever
    nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy("id"))
    return rows.join(kept, ["id", "mark"]).withColumn("nth", nth).filter("nth = 1").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


def _xxh64(text):
    def run(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest
        return pa.array(np.array([xxh64_intdigest((t.as_py() or "").encode()) for t in texts], dtype=np.uint64).view(np.int64))
    return F.arrow_udf(run, "bigint").asNondeterministic()(text)


def op12_golomb_dedup(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = """
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
placed AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM rows WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM placed
"""
