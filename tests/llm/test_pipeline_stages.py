"""The pipeline against its operators run by plain Python, and awkward tables."""

import awkward
import corpus_pipeline as cpl
from mailspark.llm import crf_pii, decontaminate, line_quality, simhash_variants
from mailspark.llm.common import read
from test_simhash_variants import brute_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark):
    docs = read(spark, SF, "documents")
    quality = cpl.quality_rules(spark, docs, SF).cache()
    want = {}
    for r in docs.collect():
        j = line_quality.judge(r.text or "")
        if j[6]:
            want[r.doc_id] = j[9]
    assert {r.doc_id: r.text for r in quality.collect()} == want

    unique = cpl.simhash_near_dedup(spark, quality, SF).cache()
    order = sorted(want)
    label = brute_components([plain_fingerprint(want[i]) for i in order], 4)
    want = {i: want[i] for k, i in enumerate(order) if label[k] == k}
    assert {r.doc_id: r.text for r in unique.collect()} == want

    clean = cpl.benchmark_decontamination(spark, unique, SF).cache()
    scanner = decontaminate.Scanner([(str(r.item_id), r.text or "") for r in read(spark, SF, "benchmark").collect()])
    for i, t in list(want.items()):
        n, hit, _ = scanner.scan(t)
        if hit and 20 * len(hit) >= n:
            del want[i]
    assert {r.doc_id: r.text for r in clean.collect()} == want

    private = cpl.pii(spark, clean, SF)
    found = {r.doc_id: r.text for r in private.collect()}
    assert set(found) == set(want)
    assert all(not crf_pii.base_spans(t) for t in found.values())
    assert all(found[i] == t for i, t in want.items() if not any(c.isdigit() or c == "@" for c in t))

    packed = cpl.best_fit_packing(spark, private, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, t in found.items() if t.strip()}


def test_awkward_tables(spark, tmp_path):
    docs = awkward.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    awkward.documents(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    bench = spark.createDataFrame([(1, None), (None, "jumps over the moon")], "item_id long, text string")
    for folder in (tmp_path, tmp_path / "none"):
        bench.write.parquet(str(folder / "benchmark.parquet"))
    at, rows = str(tmp_path), docs
    for _, stage in cpl.STAGES[:-1]:
        rows = stage(spark, rows, at)
        assert rows.columns == docs.columns
    assert cpl.run(spark, at).count() >= 2
    assert cpl.run(spark, str(tmp_path / "none")).count() == 0
