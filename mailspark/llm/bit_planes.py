"""Token ids in a binary file format of shuffled planes.

A file holds whole documents and has four parts: a fixed header, the document
index (ids and lengths), the chunk index, and the chunks.  Ids are cut into
blocks of ``BLOCK`` ids; a block is transposed into its 4 byte planes or 32 bit
planes, and each plane is compressed by zstandard on its own.  The chunk index
gives number of ids and the compressed size of every plane, so a reader can
fetch any block, or its low planes only.

Writing: documents are dealt by ranges of ``doc_id`` and sorted, each task
encodes its range and closes a file after ``FILE_IDS`` ids, so a task holds one
file at a time.  Files are rows of a Parquet folder (range, place in the
range, ids before it in the range, file image): Spark's committer decides
which attempt of a task counts, and an executor may be lost at any time.
Reading needs only sums per range to place a file among all ids.

Null texts count as empty: such documents have the end id alone.  Documents
with a null id come first; equal ids go by the hash of their text.  A very long
text makes a file of its own.  An empty table gives no file.  Other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailspark.llm.encoder import LARGE_MEMO_WORDS, encoder, vocabulary
from mailspark.session import scratch_dir

MAGIC = b"BPL1"
END_ID = 1
BLOCK = 1 << 16
FILE_IDS = 1 << 20
LEVEL = 3
#: magic, plane bits (1 or 8), block size, documents, chunks, ids
HEADER = struct.Struct("<4sIIIIQ")


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of a block, lowest first: bytes (``bits`` 8) or packed bits (1)."""
    by = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(by[:, k]).tobytes() for k in range(4)]
    rows = np.unpackbits(by, axis=1, bitorder="little")
    return [np.packbits(rows[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4")


def build_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int = 8,
               block: int = BLOCK, level: int = LEVEL) -> bytes:
    """File image of documents with ``lengths`` ids each."""
    from zstandard import ZstdCompressor

    press = ZstdCompressor(level=level).compress
    n_planes = 32 // bits
    index, chunks = [], []
    for k in range(0, len(ids), block):
        part = ids[k:k + block]
        planes = [press(p) for p in to_planes(part, bits)]
        index.append((len(part), *map(len, planes)))
        chunks += planes
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    table = np.array(index, dtype="<u4").reshape(-1, 1 + n_planes).tobytes()
    return b"".join([HEADER.pack(MAGIC, bits, block, len(doc_ids), len(index), len(ids)), docs, nulls,
                     np.array(lengths, dtype="<i8").tobytes(), table, *chunks])


class PlaneFile:
    """Reader of a file image."""

    def __init__(self, image: bytes):
        magic, self.bits, self.block, n_docs, n_chunks, self.n_ids = HEADER.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a plane file")
        self.image = image
        at = HEADER.size
        ids = np.frombuffer(image, "<i8", n_docs, at)
        nulls = np.frombuffer(image, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls)]
        self.lengths = np.frombuffer(image, "<i8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        n_planes = 32 // self.bits
        self.index = np.frombuffer(image, "<u4", n_chunks * (1 + n_planes), at).reshape(n_chunks, 1 + n_planes)
        self.start = at + self.index.nbytes + np.concatenate([[0], np.cumsum(self.index[:, 1:].sum(axis=1, dtype=np.int64))])

    def chunk(self, k: int) -> np.ndarray:
        from zstandard import ZstdDecompressor

        unpress = ZstdDecompressor().decompress
        n, at, planes = int(self.index[k, 0]), int(self.start[k]), []
        size = n if self.bits == 8 else (n + 7) // 8
        for length in self.index[k, 1:].tolist():
            planes.append(unpress(self.image[at:at + length], max_output_size=size))
            at += length
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first place in the file, ids), chunk by chunk."""
        held, k, place = np.empty(0, "<u4"), 0, 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist()):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, place, held[:n]
            held = held[n:]
            place += n


WRITTEN = "shard int, file int, before bigint, n_ids bigint, n_docs int, image binary"


def write_files(docs: DataFrame, path: str, bits: int = 8, file_ids: int = FILE_IDS, vocab: str | None = None) -> None:
    """Encodes ``docs(doc_id, text)`` in order of id and writes plane files to ``path``."""
    vocab = vocab or vocabulary()
    schema = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                        ("n_docs", pa.int32()), ("image", pa.binary())])
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        words = encoder(vocab, LARGE_MEMO_WORDS)
        shard = TaskContext.get().partitionId()
        names, lengths, parts = [], [], []
        held = file = before = 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            image = build_file(names, lengths, ids, bits)
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(
                (shard, file, before, len(ids), len(names), image), schema.types)], schema=schema)

        for batch in batches:
            ids = words.encode_all(text.as_py() or "" for text in batch.column("text"))
            for doc, raw in zip(batch.column("doc_id").to_pylist(), ids):
                raw += end
                names.append(doc)
                lengths.append(len(raw) // 4)
                parts.append(raw)
                held += lengths[-1]
                if held >= file_ids:
                    yield close()
                    file, before, held = file + 1, before + held, 0
                    names, lengths, parts = [], [], []
        if names:
            yield close()

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    # equal and null ids are dealt by their text as well, so none of them is bound to one range
    mark = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark, "text")
    ordered.mapInArrow(run, WRITTEN).write.parquet(path)


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``."""
    files = spark.read.schema(WRITTEN).parquet(path)
    # one row per range; a range is numbered in order of ids
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for shard, before, image in zip(*(batch.column(c) for c in ("shard", "before", "image"))):
                rows = [(shard.as_py(), doc, before.as_py() + place, len(ids), zlib.crc32(ids.tobytes()))
                        for doc, place, ids in PlaneFile(image.as_py()).documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    found = files.select("shard", "before", "image").mapInArrow(
        run, "shard int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(base, "shard").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op8_bit_planes(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_dir(spark, "bit-planes")
    write_files(docs, path)
    return read_files(spark, path)
