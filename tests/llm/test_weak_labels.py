import numpy as np

import awkward
from mailspark.llm import weak_labels as wl
from mailspark.llm.common import read

SF = "/root/testdata/sf0.01"


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    n, k = 40_000, len(wl.LABELLERS)
    truth = rng.random(n) < 0.7
    accuracy = np.linspace(0.6, 0.95, k)
    counts = {}
    for t in truth:
        right = rng.random(k) < accuracy
        p = "".join("-" if a else str(int(t == r)) for a, r in zip(rng.random(k) < 0.2, right))
        counts[p] = counts.get(p, 0) + 1
    good, rates, share = wl.posteriors(counts)
    assert abs(share - 0.7) < 0.03
    assert np.abs(rates[:, 1, 1] / (rates[:, 1, 1] + rates[:, 1, 0]) - accuracy).max() < 0.03
    assert all(0 <= p <= 1 for p in good.values()) and wl.posteriors({})[0] == {}


def test_agrees_with_hand_labels_it_never_saw(spark):
    got = {r.doc_id: r.kept for r in wl.op3_weak_labels(read(spark, SF, "documents")).collect()}
    labels = read(spark, SF, "labels").collect()
    right = sum(got[r.doc_id] == (r.quality == 1) for r in labels)
    assert right / len(labels) > 0.95
    clean = [r for r in labels if r.quality == 1]
    assert sum(got[r.doc_id] for r in clean) / len(clean) > 0.98


def test_awkward_rows(spark):
    rows = wl.op3_weak_labels(awkward.documents(spark)).collect()
    assert len(rows) == len(awkward.TEXTS)
    assert len({(r.score, r.votes) for r in rows if r.doc_id == 2}) == 1
    assert wl.op3_weak_labels(awkward.documents(spark, [])).count() == 0


def test_variety_covers_the_whole_of_long_texts():
    def vote(words):
        return wl.votes(b" ".join(words), words)[wl.LABELLERS.index("variety")]
    rng = np.random.default_rng(1)
    some = [b"w%d" % i for i in range(200)]
    assert vote(some) == vote(some * 2) == "1"
    # the same 200 words again and again, in order or not
    assert vote(some * 100) == "0"
    assert vote([some[i] for i in rng.integers(0, 200, 20_000)]) == "0"
    # many words in all, few in any place
    assert vote([b"v%d" % (i // 400 * 20 + i % 20) for i in range(20_000)]) == "0"
    # words as prose has them: few that are common, many that are rare
    for n in (1_000, 20_000, 200_000):
        rank = (np.exp(rng.random(n) * np.log(200_000))).astype(int)
        assert vote([b"p%d" % i for i in rank]) == "1"
    # a text whose second half repeats one passage loses its good vote only by its share
    assert wl.variety([b"n%d" % i for i in range(10_000)] + some * 50) > wl.variety(some * 100)
