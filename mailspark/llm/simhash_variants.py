"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes
(seed 42) of the text's 4-word shingles, repeats included.  Two texts link
when their fingerprints differ in at most ``max_bits`` bits.

Index: the 64 bits are cut into ``max_bits // 2 + 1`` segments, so that two
linked fingerprints differ by at most one bit in one segment.  Every distinct
fingerprint is indexed under each segment's exact value and under each
variant of a segment with one bit taken out.  Fingerprints that meet under an
exact value have an equal segment, those that meet under a variant and
disagree in the bit taken out differ by one bit there; both are verified on
all 64 bits.  A bucket reports a spanning forest of its links, never all
pairs, so the output grows with the index, whatever the groups' size.

Buckets over ``bucket_limit`` fingerprints are not compared pairwise.  Their
members meet in the balls of radius ``ceil(max_bits / 2)`` around them: two
fingerprints link exactly if one point lies within ``max_bits // 2`` bits of
one and within the rest of the other, and no point has more fingerprints than
a ball has points.  So every link is found either way.

Texts without words have fingerprint zero and link like any other.  Null texts
count as empty, very long ones are hashed in stretches, an empty table has no
components.  Null ids never name a component unless no other id is in it.
Repeated rows keep their rows and share a component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.llm.common import NULL_ID
from mailspark.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
BUCKET_LIMIT = 8192
SEED = 42


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return digest(joined, SEED)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    a, b = start[:len(words) - shingle_words + 1].tolist(), end[shingle_words - 1:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(a), 65536):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[k:k + 65536], b[k:k + 65536])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text column as a signed long."""
    def run(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t.as_py() or "", shingle_words) for t in texts], dtype=np.uint64)
        return pa.array(values.view(np.int64))
    return F.arrow_udf(run, "bigint").asNondeterministic()(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at
    most one bit."""
    n = max_bits // 2 + 1
    cut = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def slots(max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, bit taken out or -1) of every index slot."""
    return [(a, w, p) for a, w in segments(max_bits) for p in (-1, *range(w))]


def variants(prints: DataFrame, max_bits: int) -> DataFrame:
    """(slot, rest, fp): every distinct fingerprint under its segment values
    and one-wildcard variants."""
    def rest(low: int, width: int, out: int) -> Column:
        seg = F.shiftrightunsigned("fp", low)
        if width < 64:
            seg = seg.bitwiseAND(F.lit((1 << width) - 1))
        if out < 0:
            return seg
        above = F.shiftleft(F.shiftrightunsigned(seg, out + 1), out) if out < 63 else F.lit(0).cast("bigint")
        return above.bitwiseOR(seg.bitwiseAND(F.lit((1 << out) - 1)))
    rows = F.array(*[F.struct(F.lit(k).cast("smallint").alias("slot"), rest(*s).alias("rest"))
                     for k, s in enumerate(slots(max_bits))])
    return prints.select("fp", F.explode(rows).alias("v")).select("v.slot", "v.rest", "fp")


def bucket_links(prints: np.ndarray, taken: int, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among a bucket's fingerprints; for a
    variant slot (``taken`` >= 0) of links between unequal taken-out bits."""
    side = None if taken < 0 else (prints >> np.uint64(taken)) & np.uint64(1)
    left = np.arange(len(prints))  # not reached yet
    out: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            u = frontier.pop()
            near = np.bitwise_count(prints[left] ^ prints[u]) <= max_bits
            if side is not None:
                near &= side[left] != side[u]
            found = left[near]
            if len(found):
                left = left[~near]
                frontier.extend(found.tolist())
                out += [(int(prints[u]), int(prints[v])) for v in found]
    return out


def _link_buckets(max_bits: int, limit: int):
    """mapInArrow step over rows sorted by (slot, rest): rows (a, b) of links,
    and (a, null) of members of buckets over ``limit``."""
    where = [low + out if out >= 0 else -1 for low, _, out in slots(max_bits)]
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(a: list, b: list) -> pa.RecordBatch:
        x = pa.array(np.array(a, dtype=np.uint64).view(np.int64))
        y = pa.array(np.array([v or 0 for v in b], dtype=np.uint64).view(np.int64),
                     mask=np.array([v is None for v in b], dtype=bool))
        return pa.RecordBatch.from_arrays([x, y], schema=out_schema)

    def run(batches):
        slot = np.empty(0, np.int16)
        rest = np.empty(0, np.int64)
        fp = np.empty(0, np.uint64)
        over = None  # key of a bucket over the limit that is being passed on

        def close(slot, rest, fp):
            """Links of whole buckets."""
            a, b = [], []
            cut = np.flatnonzero((slot[1:] != slot[:-1]) | (rest[1:] != rest[:-1])) + 1
            start = np.concatenate([[0], cut])
            size = np.diff(np.concatenate([start, [len(fp)]]))
            taken = np.array(where)[slot[start]]
            two = np.flatnonzero(size == 2)
            x, y = fp[start[two]], fp[start[two] + 1]
            t = taken[two]
            differ = ((x ^ y) >> np.maximum(t, 0).astype(np.uint64)) & np.uint64(1)
            ok = (np.bitwise_count(x ^ y) <= max_bits) & ((t < 0) | (differ == 1))
            a += x[ok].tolist()
            b += y[ok].tolist()
            for k in np.flatnonzero(size > 2):
                found = bucket_links(fp[start[k]:start[k] + size[k]], int(taken[k]), max_bits)
                a += [u for u, _ in found]
                b += [v for _, v in found]
            return rows(a, b)

        for batch in batches:
            slot = np.concatenate([slot, batch.column("slot").to_numpy()])
            rest = np.concatenate([rest, batch.column("rest").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if over is not None:  # pass on what still belongs to it
                same = (slot == over[0]) & (rest == over[1])
                yield rows(fp[same].tolist(), [None] * int(same.sum()))
                if same.all():
                    slot, rest, fp = slot[:0], rest[:0], fp[:0]
                    continue
                slot, rest, fp, over = slot[~same], rest[~same], fp[~same], None
            if not len(slot):
                continue
            # the large buckets of this stretch, then all whole ones; the last stays open
            cut = np.flatnonzero((slot[1:] != slot[:-1]) | (rest[1:] != rest[:-1])) + 1
            start = np.concatenate([[0], cut])
            size = np.diff(np.concatenate([start, [len(fp)]]))
            large = np.repeat(size > limit, size)
            if large.any():
                if large[-1]:
                    over = (slot[-1], rest[-1])
                yield rows(fp[large].tolist(), [None] * int(large.sum()))
                keep = ~large
                tail = 0 if over is not None else int(size[-1])
                slot, rest, fp = slot[keep], rest[keep], fp[keep]
            else:
                tail = int(size[-1])
            done = len(fp) - tail
            if done:
                yield close(slot[:done], rest[:done], fp[:done])
                slot, rest, fp = slot[done:], rest[done:], fp[done:]
        if len(fp):
            yield close(slot, rest, fp)

    return run


def ball_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) among ``members(fp)``, in number linear in the members, by
    the points that two of them have in reach."""
    reach = (max_bits + 1) // 2
    flips = [(0, 0)] + [(sum(1 << i for i in c), n) for n in range(1, reach + 1) for c in combinations(range(64), n)]
    masks = pa.array(np.array([m for m, _ in flips], dtype=np.uint64).view(np.int64)).to_numpy()
    far = np.array([n for _, n in flips], dtype=np.int8)

    def points(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for k in range(0, len(fp), 64):
                f = fp[k:k + 64]
                yield pa.RecordBatch.from_arrays([
                    pa.array((f[:, None] ^ masks[None, :]).ravel()), pa.array(np.repeat(f, len(masks))),
                    pa.array(np.tile(far, len(f)))], names=["point", "fp", "far"])

    at = members.mapInArrow(points, "point bigint, fp bigint, far tinyint")
    balls = (at.groupBy("point")
             .agg(F.min(F.when(F.col("far") <= max_bits // 2, F.col("fp"))).alias("a"), F.collect_set("fp").alias("fps"))
             .filter((F.size("fps") > 1) & F.col("a").isNotNull()))
    return balls.select("a", F.explode("fps").alias("b")).filter("a <> b").distinct()


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``prints(fp)`` as
    all links within ``max_bits`` would."""
    found = (variants(prints, max_bits).repartition("slot", "rest").sortWithinPartitions("slot", "rest")
             .mapInArrow(_link_buckets(max_bits, bucket_limit), "a bigint, b bigint").distinct().checkpoint())
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp"))
    return found.filter("b IS NOT NULL").unionByName(ball_links(crowded, max_bits))


def near_duplicates(ids: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Components of ``ids(doc_id, mark, fp)``: one row per distinct
    fingerprint, (fp, component_id, first_mark), where ``component_id`` is the
    smallest id of the component and ``first_mark`` the smallest mark it has."""
    prints = ids.groupBy("fp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")).checkpoint()
    groups = components(links(prints.select("fp"), max_bits, bucket_limit))
    placed = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    # written down, so that the join deals both sides anew and a large component's rows can be split
    first = placed.groupBy("component").agg(F.min("first").alias("least")).checkpoint()
    return placed.select("fp", "component").join(first, "component").select(
        "fp", F.col("least.doc_id").alias("component_id"), F.col("least.mark").alias("first_mark"))


def op10_simhash(docs: DataFrame) -> DataFrame:
    ids = docs.select(docs["doc_id"], F.lit(0).cast("bigint").alias("mark"),
                      fingerprints(docs["text"]).alias("fp")).checkpoint()
    found = near_duplicates(ids).select("fp", "component_id")
    return ids.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: a row of the smallest id; where
    that id is repeated, the one whose text has the smallest hash.  Rows are
    found again by id and text hash, so fingerprints are computed once."""
    def keys(text):
        return F.coalesce(docs["doc_id"], F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")
    ids = docs.select(docs["doc_id"], keys(docs["text"])[1], fingerprints(docs["text"]).alias("fp")).checkpoint()
    first = near_duplicates(ids).select(
        F.coalesce("component_id", F.lit(NULL_ID)).alias("id"), F.col("first_mark").alias("mark")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keys(docs["text"]))
    # a component has one (id, mark); its rows differ only where a row is repeated
    nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy("id"))
    return rows.join(first, ["id", "mark"]).withColumn("nth", nth).filter("nth = 1").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
