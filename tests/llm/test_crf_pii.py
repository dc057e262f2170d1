import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings, strategies as st

import awkward
from mailspark.llm import crf_pii as cp
from mailspark.llm.common import read


def plain_spans(text):
    """Base kinds by the plain expressions."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and cp.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PARTS = st.lists(st.sampled_from(["a", "b@c", ".", "@", "x.com", "-", "+", " ", "1", "12", "255", "256", "4111 1111 1111 1111", "00",
                                  "+49 (30) 123-4567", "é", "\n", "%", "_"]), max_size=16).map("".join)


@settings(max_examples=800, deadline=None)
@given(PARTS)
def test_base_equals_plain_expressions(text):
    assert cp.base_spans(text) == plain_spans(text)


def test_long_texts_take_linear_time():
    for text in ("x" * 200_000, "1" * 200_000, "a@" * 60_000, "1." * 60_000, "+1" * 60_000, "+1 " + "(" * 100_000, "a.b" * 50_000 + "@"):
        cp.base_spans(text)
        cp.runs_of(text)


def tiny_field(seed):
    f = cp.Field()
    rng = np.random.default_rng(seed)
    f.emit = rng.normal(size=f.emit.shape)
    f.move, f.start, f.stop = (rng.normal(size=w.shape) for w in (f.move, f.start, f.stop))
    return f


def path_score(f, feats, tags):
    s = f.start[tags[0]] + f.barred_start[tags[0]] + f.stop[tags[-1]] + sum(f.emit[x, t].sum() for x, t in zip(feats, tags))
    return s + sum((f.move + f.barred)[a, b] for a, b in zip(tags, tags[1:]))


def test_viterbi_and_likelihood_equal_enumeration():
    f = tiny_field(1)
    runs = [[[1, 2]], [[3, 4], [5, 6]], [[7, 1], [2, 9], [4, 4]], [[8, 8], [1, 1]]]
    for feats, tags in zip(runs, f.decode(runs)):
        every = list(itertools.product(range(len(cp.TAGS)), repeat=len(feats)))
        best = max(every, key=lambda t: path_score(f, feats, t))
        assert list(best) == tags
    # gradient of the log-likelihood by differences
    feats, tags = np.array([[[7, 1], [2, 9]]]), np.array([[1, 2]])

    def loss():
        every = itertools.product(range(len(cp.TAGS)), repeat=2)
        return np.log(sum(np.exp(path_score(f, feats[0], t)) for t in every)) - path_score(f, feats[0], tags[0])
    g_emit, g_move, g_start, g_stop = f._gradient(feats, tags)
    for w, g, at in ((f.emit, g_emit, (7, 1)), (f.emit, g_emit, (2, 5)), (f.move, g_move, (1, 2)), (f.move, g_move, (0, 3)),
                     (f.start, g_start, (1,)), (f.stop, g_stop, (4,))):
        old = w[at]
        w[at] = old + 1e-4
        up = loss()
        w[at] = old - 1e-4
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-4


def test_field_learns_held_out_runs(spark):
    """Tags of runs of other documents, against the base patterns."""
    docs = read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    fit, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    field = cp.train_field(cp.label_runs(fit))
    rows = cp.label_runs(held, 10_000).collect()
    got = field.decode([cp.features(r.tokens, r.before, r.after) for r in rows])
    pairs = [(a, b) for r, tags in zip(rows, got) for a, b in zip(r.tags, tags)]
    assert len(pairs) > 500
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97


def test_query_keeps_base_spans(spark):
    docs = awkward.documents(spark)
    rows = {r.doc_id: r for r in cp.op2_crf_pii(docs).collect()}
    text = dict(awkward.TEXTS)
    for i, r in rows.items():
        base = cp.describe(plain_spans(text[i] or "")) if i in (6, 3, 4, 7, 10) else None
        if base is not None:
            import hashlib
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert rows[6].n_email == rows[6].n_ip == rows[6].n_phone == 1
    clean = cp.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    out = {r.doc_id: r for r in clean.collect()}
    assert "[EMAIL]" in out[6].text and "[PHONE]" in out[6].text and "jane" not in out[6].text
    assert out[6].n_chars == len(out[6].text) and out[3].text is None and out[6].row == "clash"
    assert cp.op2_crf_pii(awkward.documents(spark, [])).count() == 0


def test_redaction_of_overlaps():
    assert cp.redact_text("abcdefgh", [(1, 0, 4), (2, 1, 6), (7, 2, 8)]) == "a[EMAIL]g[CARD]"


def test_counts_per_kind(spark):
    """Spans of one kind in any place of the text count as that kind, and only as it."""
    texts = [(1, "a@b.cd x@y.zz u@v.ww"), (2, "10.0.0.1 then 4111 1111 1111 1111, +49 30 1234567890 and 10.0.0.2"),
             (3, "from 10.0.0.9 to jane.doe@example.com"), (4, "none 12"), (5, None)]
    for r in cp.op2_crf_pii(awkward.documents(spark, texts)).collect():
        spans = plain_spans(dict(texts)[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(cp.describe(spans).encode()).hexdigest()
