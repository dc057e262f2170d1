from hypothesis import given, settings, strategies as st

import awkward
from mailspark.llm import line_quality as lq


def brute(text):
    """Base counts from the definitions."""
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [" ".join(words[i:i + 5]) for i in range(n - 4)] if n >= 5 else []
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\v|#é\x85\u00a0."), max_size=60))
def test_base_counts(text):
    assert lq.judge(text)[:6] == brute(text)


def test_line_rules():
    good = awkward.CLEAN
    assert not lq.line_fails(good.encode())
    assert lq.line_fails(b"Home | About | Contact | Help")
    assert lq.line_fails("Start » News » Sport » Local".encode())
    assert lq.line_fails(b"BUY!! NOW!! CHEAP!! STUFF!!")
    assert lq.line_fails(b"one### two%%% three&&& four***")
    assert lq.line_fails(b"Copyright 2020. All rights reserved.")
    assert not lq.line_fails(b"Short title")
    mixed = lq.judge(good + "\nHome | About | Contact | Help")
    assert mixed[6] and mixed[7] == 1 and mixed[9] == good
    assert not lq.judge("Home | About | Contact | Help me | Again | And again | Once more")[6]


def test_awkward_rows(spark):
    docs = awkward.documents(spark)
    rows = {(r.doc_id, r.n_words): r for r in lq.op9_line_quality(docs).collect()}
    assert len(lq.op9_line_quality(docs).collect()) == len(awkward.TEXTS)
    assert rows[(3, 0)].base_failed and not rows[(3, 0)].kept
    kept = lq.clean_documents(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.filter("doc_id <= 2").collect()) == [1, 2, 2]
    assert kept.filter("doc_id = 1").first().row == "clash"
    assert lq.clean_documents(awkward.documents(spark, [])).count() == 0
