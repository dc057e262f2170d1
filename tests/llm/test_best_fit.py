import hashlib
import random

import awkward
import pytest
from mailspark.llm import best_fit as bf
from mailspark.llm.encoder import WordEncoder, vocabulary


def total_cost(sizes, placed, capacities):
    held = {}
    for s, (k, _) in zip(sizes, placed):
        held[k] = held.get(k, 0) + s
    return sum(bf.cost(min(c for c in capacities if c >= n)) for n in held.values())


def least_cost(sizes, capacities):
    """Over all ways to share pieces out."""
    best = [float("inf")]

    def place(k, held):
        if k == len(sizes):
            best[0] = min(best[0], sum(bf.cost(min(c for c in capacities if c >= n)) for n in held))
            return
        for i in range(len(held)):
            if held[i] + sizes[k] <= max(capacities):
                held[i] += sizes[k]
                place(k + 1, held)
                held[i] -= sizes[k]
        held.append(sizes[k])
        place(k + 1, held)
        held.pop()
    place(0, [])
    return best[0]


def test_best_fit_by_looking_at_every_bin():
    rng = random.Random(2)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 1024) for _ in range(rng.randrange(120))), reverse=True)
        placed = bf.pack(sizes, (128, 512, 1024))
        room = {}
        for s, (k, offset) in zip(sizes, placed):
            fits = [(r, i) for i, r in room.items() if r >= s]
            assert (min(fits)[1] if fits else len(room)) == k
            if not fits:  # opened in a permitted length; how much it holds is seen at the end
                room[k] = next(c for c in (128, 512, 1024) if c == bf.cheapest([-x for x in sizes], placed.index((k, 0)), (128, 512, 1024)))
            room[k] -= s


def test_the_least_cost_bin_is_not_the_smallest():
    """A small piece opens a long sequence where others follow that fill it, and a short one where none does."""
    assert bf.cheapest([-300], 0) == 512
    assert bf.cheapest([-256] * 100, 0) == 4096
    assert bf.cheapest([-300] * 100, 0) == 8192  # 27 of them fill it better than 13 fill 4096
    assert bf.cheapest([-5000] + [-100] * 200, 0) == 8192
    assert bf.cheapest([-600, -500, -400], 0) == 1024
    assert bf.cheapest([-600, -500, -400, -400], 0) == 2048
    held = {}
    for k, offset in bf.pack([256] * 130):
        held[k] = max(held.get(k, 0), offset + 256)
    assert sorted(held.values()) == [512] + [4096] * 8


def test_bins_are_downsized(spark):
    """A long sequence that later pieces, put elsewhere, did not fill."""
    rng = random.Random(3)
    opened = downsized = 0
    for _ in range(30):
        sizes = sorted((rng.randint(1, 3000) for _ in range(60)), reverse=True)
        falling, seen, held = [-s for s in sizes], {}, {}
        for i, (k, offset) in enumerate(bf.pack(sizes)):
            seen.setdefault(k, bf.cheapest(falling, i))
            held[k] = offset + sizes[i]
        opened += len(seen)
        downsized += sum(min(c for c in bf.CAPACITIES if c >= held[k]) < c0 for k, c0 in seen.items())
    assert 0 < downsized < opened


def test_cost_against_exhaustive_search():
    rng = random.Random(8)
    capacities, worse = (512, 1024, 2048), []
    for _ in range(60):
        sizes = sorted((rng.randint(1, 1500) for _ in range(rng.randint(1, 7))), reverse=True)
        least = least_cost(sizes, capacities)
        worse.append(total_cost(sizes, bf.pack(sizes, capacities), capacities) / least)
    assert min(worse) >= 1 - 1e-12 and max(worse) < 1.35 and sum(worse) / len(worse) < 1.05


def test_joint_choice_is_cheaper_than_the_smallest_length():
    rng = random.Random(9)
    sizes = sorted((min(8192, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)), reverse=True)
    smallest = [s for s in sizes]
    plain = {}
    for s in smallest:  # best fit decreasing into the smallest length that takes a piece
        fits = [(r, k) for k, (r, _) in plain.items() if r >= s]
        k = min(fits)[1] if fits else len(plain)
        room, c = plain.get(k, (min(c for c in bf.CAPACITIES if c >= s),) * 2)
        plain[k] = room - s, c
    assert total_cost(sizes, bf.pack(sizes), bf.CAPACITIES) < 0.95 * sum(bf.cost(c) for _, c in plain.values())


def check(rows, counts):
    total, bins = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert total == counts
    for rs in bins.values():
        rs.sort(key=lambda r: r.offset)
        end = 0
        for r in rs:
            assert r.offset == end
            end += r.n_tokens
        assert {r.capacity for r in rs} == {min(c for c in bf.CAPACITIES if c >= end)}


def test_documents(spark):
    words = WordEncoder(vocabulary())
    counts = {}
    for i, t in awkward.TEXTS:
        n = len(words.encode(t or "")) // 4
        if n:
            counts[i] = counts.get(i, 0) + n
    rows = bf.pack_documents(awkward.documents(spark)).collect()
    check(rows, counts)
    assert max(r.piece for r in rows) > 0
    assert bf.pack_documents(awkward.documents(spark, [])).count() == 0


def test_many_groups(spark):
    rng = random.Random(5)
    counts = {i: rng.randint(1, 8192) for i in range(500)}
    pieces = spark.createDataFrame([(i, 0, n, 0) for i, n in counts.items()], "doc_id long, piece int, n_tokens int, salt long")
    check(bf.pack_pieces(pieces, 500, group_pieces=60).collect(), counts)


def test_counts_are_lengths_of_the_ids():
    from mailspark.llm.encoder import WordEncoder, vocabulary
    texts = ["", "plain words, and more.", "A<|endoftext|>b <|x", "caf\u00e9 caf\u00e9. 12,5 . ,", "w1 w2. w3, " * 9, " \t\n"]
    ids, counts = WordEncoder(vocabulary(), 5), WordEncoder(vocabulary(), 5, counts=True)
    for _ in range(2):
        for t in texts:
            assert counts.count(t) == len(ids.encode(t)) // 4
            assert counts.count(t) == len(ids.full.encode(t, add_special_tokens=False).ids)


def test_sequences_hold_every_text(spark, tmp_path):
    docs = awkward.documents(spark)
    words = WordEncoder(vocabulary())
    want = {}
    for i, t in awkward.TEXTS:
        ids = words.full.encode(t or "", add_special_tokens=False).ids
        if ids:
            want.setdefault((i, hashlib.sha256(t.encode()).hexdigest()), []).append(ids)
    assert len(want) < sum(map(len, want.values()))  # copies
    bf.write_sequences(docs, str(tmp_path / "packed"))
    got, n = {}, 0
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        assert len(r.ids) <= r.capacity and [p.offset for p in r.parts] == sorted({p.offset for p in r.parts})
        assert sum(p.n_tokens for p in r.parts) == len(r.ids)
        for p in r.parts:
            got.setdefault((p.doc_id, p.text_sha256, p.start), []).append(r.ids[p.offset:p.offset + p.n_tokens])
            n += p.n_tokens
    assert n == sum(len(ids) for copies in want.values() for ids in copies)
    for (i, key, start), pieces in got.items():
        assert pieces == [ids[start:start + max(bf.CAPACITIES)] for ids in want[i, key]]
    # placements name their rows; the query stays the assignment
    placed = bf.pack_documents(docs)
    assert {"text_sha256", "start"} <= set(placed.columns)
    assert bf.op7_best_fit(docs).columns == [c.split()[0] for c in bf.PACKED.split(", ")]
    assert bf.sequences(docs, placed).count() == len({r.bin_id for r in placed.collect()})
    with pytest.raises(Exception, match="does not fit"):
        bf.sequences(docs.filter("doc_id <> 7"), placed).collect()
    assert bf.sequences(docs.filter("false"), placed.filter("false")).count() == 0
