"""Best-fit packing into sequences of several permitted lengths.

Documents are measured in tokens and cut into pieces of at most the largest
capacity.  Pieces are dealt to groups of about ``GROUP_PIECES`` at random by
hash, so the number of groups follows the input and a group's size does not.
A group is packed in one task: pieces in falling size go to the open bin with
the least room that still takes them; if none does, every permitted length is
filled, largest first, with the sizes that are still to come, and the one is
opened whose cost per token it would then hold is least; at the end every bin
is taken down to the smallest permitted length that holds its contents.  The
cost of a sequence of ``c`` tokens is ``START + c + c * c / ATTENTION``: full
sequences of 4096 are the cheapest, short ones pay the fixed part, long ones
the attention.

Null and empty texts have no tokens and no piece.  Null and repeated ids are
packed like others.  Other columns are not read.

A placement carries the SHA-256 of its document's text and the piece's first
token, so it names its text also where the id is null or repeated (rows of one
id and text are copies).  ``sequences`` joins placements back to the texts, and
``write_sequences`` packs documents and writes the sequences' token ids.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.encoder import LARGE_MEMO_WORDS, encoder, vocabulary

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: fixed cost of a sequence, in tokens, and how attention grows
START = 256
ATTENTION = 65536
GROUP_PIECES = 20_000


def cost(capacity: int) -> float:
    return START + capacity + capacity * capacity / ATTENTION


def expected(falling: list[int], k: int, room: int) -> int:
    """Tokens of the pieces from ``k`` on that fill ``room`` largest first;
    ``falling`` has the negated sizes, in falling size."""
    free = room
    while (k := bisect_left(falling, -free, k)) < len(falling):
        free += falling[k]
        k += 1
    return room - free


def cheapest(falling: list[int], k: int, capacities=CAPACITIES) -> int:
    """Capacity to open for piece ``k``: what the pieces after it would fill is
    known from their sizes, and the bin will be downsized to that; the capacity
    with the least cost per token is taken, the smaller one of equals."""
    size = -falling[k]
    best = None
    for c in capacities:
        if c >= size:
            held = size + expected(falling, k + 1, c - size)
            price = cost(next(d for d in capacities if d >= held)) / held
            if best is None or price < best[0]:
                best = price, c
    return best[1]


def pack(sizes: list[int], capacities=CAPACITIES) -> list[tuple[int, int]]:
    """(bin, offset) of each of ``sizes``, which fall; ``capacities`` rise."""
    falling = [-s for s in sizes]
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    capacity: list[int] = []
    out = []
    for i, size in enumerate(sizes):
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, at = rooms.pop(k)
        else:
            at = len(capacity)
            capacity.append(cheapest(falling, i, capacities))
            room = capacity[at]
        out.append((at, capacity[at] - room))
        if room > size:
            insort(rooms, (room - size, at))
    return out


def token_count(text: Column, vocab: str | None = None) -> Column:
    vocab = vocab or vocabulary()

    def run(texts: pa.Array) -> pa.Array:
        words = encoder(vocab, LARGE_MEMO_WORDS, counts=True)
        return pa.array(list(words.count_all(t.as_py() or "" for t in texts)), type=pa.int64())
    return F.arrow_udf(run, "bigint").asNondeterministic()(text)


PACKED = "doc_id bigint, piece int, n_tokens int, bin_id bigint, capacity int, offset int"
#: what pack_documents returns beside PACKED
PLACED = PACKED + ", text_sha256 string, start bigint"


def pack_pieces(pieces: DataFrame, n_pieces: int, capacities=CAPACITIES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """PACKED rows for ``pieces(doc_id, piece, n_tokens, salt)``; ``salt`` tells
    rows of one id apart.  Further columns of ``pieces`` are carried along."""
    groups = max(1, -(-n_pieces // group_pieces))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("bin_id", pa.int64()),
                        ("capacity", pa.int32()), ("offset", pa.int32())])
    capacities = tuple(sorted(capacities))
    more = [f for f in pieces.schema.fields if f.name not in ("doc_id", "piece", "n_tokens", "salt")]
    packed = PACKED + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    names = [f.name for f in more]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n_tokens", "doc_id", "piece", "salt")), range(len(table))),
                      key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[3]))
        placed = pack([r[0] for r in rows], capacities)
        filled: dict[int, int] = {}
        for (at, offset), r in zip(placed, rows):
            filled[at] = max(filled.get(at, 0), offset + r[0])
        fits = {at: next(c for c in capacities if c >= n) for at, n in filled.items()}
        base = key[0].as_py() << 32
        out = pa.table([
            [r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows], [base + at for at, _ in placed],
            [fits[at] for at, _ in placed], [offset for _, offset in placed]], schema=schema)
        order = pa.array([r[4] for r in rows], type=pa.int64())
        for c in names:
            out = out.append_column(c, table.column(c).take(order))
        return out

    group = F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups))
    return pieces.withColumn("grp", group).groupBy("grp").applyInArrow(run, packed)


def pack_documents(docs: DataFrame, capacities=CAPACITIES) -> DataFrame:
    """PLACED rows for documents with ``doc_id`` and ``text``."""
    most = max(capacities)
    counted = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), token_count(docs["text"]).alias("n"),
                          F.xxhash64(docs["text"]).alias("salt"), F.sha2(docs["text"], 256).alias("text_sha256")).checkpoint()
    n_pieces = F.ceil(F.col("n") / most)
    total = counted.agg(F.coalesce(F.sum(n_pieces), F.lit(0)).alias("n")).first().n
    cut = counted.filter("n > 0").withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "n", "text_sha256", F.xxhash64("salt", "row").alias("salt"), F.explode(F.sequence(F.lit(0), n_pieces.cast("int") - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * most
    pieces = cut.select("doc_id", "piece", F.least(F.lit(most), F.col("n") - start).cast("int").alias("n_tokens"), "salt",
                        "text_sha256", start.alias("start"))
    return pack_pieces(pieces, total, capacities)


def piece_ids(text: Column, most: int, vocab: str | None = None) -> Column:
    """Token ids of a text, in pieces of ``most``."""
    vocab = vocab or vocabulary()

    def run(texts: pa.Array) -> pa.Array:
        words, out = encoder(vocab), []
        for t in texts:
            ids = np.frombuffer(words.encode(t.as_py()) if t.is_valid else b"", dtype="<u4").astype(np.int32)
            out.append([ids[i:i + most] for i in range(0, len(ids), most)])
        return pa.array(out, type=pa.list_(pa.list_(pa.int32())))
    return F.arrow_udf(run, "array<array<int>>").asNondeterministic()(text)


def sequences(docs: DataFrame, placed: DataFrame, capacities=CAPACITIES) -> DataFrame:
    """One row per sequence of ``placed`` (pack_documents of ``docs`` with the
    same ``capacities``): ``bin_id``, ``capacity``, ``ids`` and its ``parts`` in
    order.  Raises where a placement has no text in ``docs``."""
    texts = docs.select(F.sha2(docs["text"], 256).alias("text_sha256"), docs["text"].alias("text")) \
        .filter("text IS NOT NULL").dropDuplicates(["text_sha256"])
    cut = texts.select("text_sha256", F.posexplode(piece_ids(F.col("text"), max(capacities))).alias("piece", "ids"))
    part = ("doc_id", "text_sha256", "piece", "start", "n_tokens", "offset")
    whole = F.when(F.size("ids").eqNullSafe(F.col("n_tokens")), F.col("ids")).otherwise(
        F.raise_error(F.lit("a placement does not fit the text of these documents")))
    found = placed.join(cut, ["text_sha256", "piece"], "left").select("bin_id", "capacity", *part, whole.alias("ids"))
    # at most ``capacity`` tokens and pieces meet in a group
    grouped = found.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", *part[:-1]))).alias("p"))
    return grouped.select("bin_id", "capacity", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
                          F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in part])).alias("parts"))


def write_sequences(docs: DataFrame, path: str, capacities=CAPACITIES) -> None:
    """Packs ``docs`` and writes their sequences as Parquet."""
    sequences(docs, pack_documents(docs, capacities), capacities).write.parquet(path)


def op7_best_fit(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).drop("text_sha256", "start")
