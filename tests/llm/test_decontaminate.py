import random

import awkward
from mailspark.llm import decontaminate as dc


def brute(text, items):
    words = dc.split_words(text)
    hit, found = set(), set()
    for item, body in items:
        for w in dc.windows_of(dc.split_words(body)):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(words), sorted(hit), sorted(found)


def test_scan_equals_search():
    rng = random.Random(3)
    vocab = ["a", "b", "é", "c1"]
    items = [(str(k), " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 13, 20])))) for k in range(40)]
    scanner = dc.Scanner(items)
    for _ in range(60):
        text = ", ".join(rng.choices(vocab + ["zz"], k=rng.randrange(60)))
        assert scanner.scan(text) == brute(text, items)


def test_spans_are_places_in_the_original():
    text = "Ünder: THE -- quick_brown (fox)!"
    _, hit, _ = dc.Scanner([("1", "the quick"), ("2", "fox")]).scan(text)
    assert [text[a:b] for a, b in dc.spans_of(text, hit)] == ["THE -- quick", "fox"]


def test_blocks_give_the_same(spark):
    docs = awkward.documents(spark)
    bench = spark.createDataFrame([(1, awkward.CLEAN), (None, "text number 7"), (3, None), (4, "!!"), (5, "More")],
                                  "item_id long, text string")
    def rows(n):
        return sorted((str(r.row.doc_id), str(r.row.text)[:20], len(r.row.text or ""), r.hits.n_words, r.hits.words, r.hits.items, r.hits.spans)
                      for r in dc.scan_documents(docs, bench, max_bytes=n).collect())
    assert rows(1) == rows(1 << 20)
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and 2 not in ids and 3 in ids and 4 in ids and 7 in ids
    assert dc.drop_contaminated(docs, bench.filter("false")).count() == docs.count()
    assert dc.drop_contaminated(awkward.documents(spark, []), bench).count() == 0


def test_blocks_hold_a_bounded_number_of_windows(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "\u00e9", "C1"]
    items = [(k, ", ".join(rng.choices(vocab, k=n))) for k, n in enumerate([0, 3, 13, 14, 30, 200, 500, 12])]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    blocks = [b.value for b in dc._blocks(bench, dc.MAX_BYTES, 50, dc.WINDOW)]
    assert len(blocks) > 10
    every = {}
    for block in blocks:
        windows = [(i, w) for i, t in block for w in dc.windows_of(dc.split_words(t))]
        assert len(windows) <= 50
        for i, w in windows:
            every.setdefault(i, []).append(w)
    # no window is lost, made up or found twice
    assert every == {str(k): dc.windows_of(dc.split_words(t)) for k, t in items if t}
    texts = [", ".join(rng.choices(vocab + ["zz"], k=rng.randrange(60))) for _ in range(30)] + [items[6][1][40:700]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in dc.scan_documents(docs, bench, max_windows=200).collect():
        assert (r.hits.n_words, r.hits.words, r.hits.items) == brute(r.row.text, [(str(k), t) for k, t in items])
        assert [(s.start, s.end) for s in r.hits.spans] == dc.spans_of(r.row.text, r.hits.words)
    # one text of the size of a few blocks leaves the default with several
    wide = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3 * dc.MAX_WINDOWS)))], "item_id long, text string")
    assert len(dc._blocks(wide, dc.MAX_BYTES, dc.MAX_WINDOWS, dc.WINDOW)) == 3
