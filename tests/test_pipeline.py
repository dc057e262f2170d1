"""Sources, numbering, cleaning, models, scoring stream = batch."""

import pytest
from pyspark.sql import Window, functions as F

from conftest import SF_SMALL
from mailspark.operators import clean as C
from mailspark.operators import compact as CP
from mailspark.operators import importance as IM
from mailspark.operators import metrics as M
from mailspark.operators import models as MD
from mailspark.operators.folds import stratified_folds
from mailspark.operators.numbering import row_number_by
from mailspark.plans.experiment import run_matrix
from mailspark.session import scratch_dir
from mailspark.sources import fixtures as fx
from mailspark.sources import mail as ML
from mailspark.sources.synthetic import fallback_training_table, generate_synthetic


def test_row_number_by_equals_window(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 3).alias("g"),
                                     F.md5(F.col("id").cast("string")).alias("k"))
    a = row_number_by(df, ["g"], ["k", "id"], out="rn", num_partitions=7)
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == 5000


def test_mail_dir_labels_and_counts(spark, tmp_path):
    for cls, n in (("ham", 3), ("spam", 2)):
        d = tmp_path / "corpus" / cls
        d.mkdir(parents=True)
        for i in range(n):
            (d / f"m{i}.eml").write_bytes(b"Subject: caf\xe9\nFrom: a@b.example\n\nbody\n")
    rm = ML.read_mail_dir(spark, str(tmp_path / "corpus"))
    assert sorted(r["label"] for r in rm.collect()) == [0, 0, 0, 1, 1]
    assert rm.select(F.length("raw")).first()[0] > 0
    counts = {r["class"]: r["n_files"] for r in ML.corpus_counts(spark, str(tmp_path / "corpus")).collect()}
    assert counts == {"ham": 3, "spam": 2}
    capped = ML.cap_per_class(rm, 2)
    assert capped.groupBy("label").count().orderBy("label").collect()[0]["count"] == 2
    feats = CP.compact_features(rm).first()
    assert feats["subject_len"] == 4


def test_mbox_split(spark, tmp_path):
    p = tmp_path / "phishing-2020.txt"
    p.write_text("From a@x Mon Jan  1 00:00:00 2020\nSubject: one\n\nbody1\n\n"
                 "From b@x Mon Jan  1 00:00:00 2020\nSubject: two\n\nbody2\n")
    got = ML.read_mbox(spark, str(tmp_path / "phishing-*.txt")).orderBy("mail_id").collect()
    assert [r["mail_id"] for r in got] == ["phishing-2020_00000", "phishing-2020_00001"]
    assert got[0]["raw"] == "Subject: one\n\nbody1\n"
    assert got[1]["raw"].startswith("Subject: two\n")
    q = tmp_path / "junk" / "phishing-2021.txt"
    q.parent.mkdir()
    q.write_text("stray preamble\nmore\nFrom a@x Mon Jan  1 00:00:00 2021\nSubject: only\n\nbody\n")
    got = ML.read_mbox(spark, str(q)).collect()
    assert [(r["mail_id"], r["raw"]) for r in got] == [("phishing-2021_00000", "Subject: only\n\nbody\n")]


def test_clean_and_encode_traps(spark):
    fm = fx.feature_matrix(spark, SF_SMALL)
    out, dropped = C.clean_and_encode(fm, "A")
    assert "label" in out.columns and "has_from" in dropped       # T4: label kept, constant dropped
    assert "_source_file" not in out.columns
    assert out.where(F.col("subject_len").isNull()).count() == 0
    # The rare flag is clipped to 0 and disappears in 'reference' mode
    assert "from_non_ascii" in dropped
    out2, dropped2 = C.clean_and_encode(fm, "A", clip_mode="counts")
    assert "from_non_ascii" not in C.count_columns(fx.FEATURE_MATRIX_FEATURES, "counts")


def test_synthetic_separates_and_rf_learns(spark):
    a = generate_synthetic(spark, 300, 300, "A")
    assert len(a.columns) == 83 and a.count() == 600
    m = a.groupBy("label").agg(F.avg("reply_to_present_and_differs").alias("r")).orderBy("label").collect()
    assert m[0]["r"] < 0.25 < m[1]["r"]
    folded = stratified_folds(a, k=3)
    cols = [c for c in a.columns if c not in ("mail_id", "label")]
    pred = MD.cv_predictions(folded, cols, "RF", "A", "all", k=3, params={"numTrees": 30, "maxDepth": 10})
    acc = M.classification_metrics(pred, keys=["model_name"]).first()["accuracy"]
    assert acc >= 0.95
    b = generate_synthetic(spark, 300, 300, "B")
    ratio = b.agg(F.avg("n_received_hops")).first()[0] / a.agg(F.avg("n_received_hops")).first()[0]
    assert 0.25 < ratio < 0.55


def test_experiment_matrix_and_importance(spark):
    a = generate_synthetic(spark, 150, 150, "A")
    out = run_matrix(spark, {"A": a}, groups=("G8",), models=("RF", "OC_SVM"), k=3, parallel_cells=2,
                     params={"RF": {"numTrees": 20, "maxDepth": 8}, "OC_SVM": {"n_components": 32}})
    res = {r["model_name"]: r for r in out["results"].collect()}
    assert set(res) == {"RF", "OC_SVM"} and res["RF"]["n_features"] == 5
    assert res["RF"]["accuracy"] > res["OC_SVM"]["accuracy"] - 0.05
    assert out["failures"].count() == 0
    cols = ["reply_to_present_and_differs", "has_received", "has_from"]
    imp = IM.dataset_importance(a, cols, n_repeats=2).collect()
    assert imp[0]["feature"] == "reply_to_present_and_differs"


def test_stream_scoring_equals_batch(spark):
    from mailspark.operators.score import score_v1, documents_as_requests, detection_rate
    from mailspark.streaming.score_stream import start_scoring
    train = fallback_training_table(spark, 400)
    model = MD.fit_pipeline(train, CP.COMPACT_FEATURES, num_trees=10, max_depth=5)
    feats = CP.compact_features(fx.raw_mail(spark, SF_SMALL)).withColumn("email_id", F.col("mail_id").cast("string"))
    reqs = documents_as_requests(CP.documents(feats))
    in_dir, out_dir, ck = (scratch_dir(spark, x) for x in ("req", "scored", "ck"))
    reqs.write.json(in_dir)
    q = start_scoring(spark, model, in_dir, out_dir, ck, multiline=False)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out_dir).select("email_id", "prediction", "confidence")
    batch = score_v1(reqs, model).select("email_id", "prediction", "confidence")
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0
    rate = detection_rate(score_v1(reqs, model)).first()
    assert rate["malicious"] + rate["legitimate"] == rate["total"]
    from mailspark.streaming.score_stream import start_counts
    c = start_counts(spark, model, in_dir, "mail_counts", scratch_dir(spark, "ck2"), multiline=False)
    c.awaitTermination(300)
    counts = {r["prediction"]: r["n"] for r in spark.sql("SELECT * FROM mail_counts").collect()}
    assert counts.get("malicious", 0) == rate["malicious"]


def test_build_and_prepare_datasets(spark, tmp_path):
    from mailspark.plans.dataset import build_dataset, prepare_datasets
    for cls, n in (("ham", 4), ("spam", 3)):
        d = tmp_path / "A" / cls
        d.mkdir(parents=True)
        for i in range(n):
            extra = "Reply-To: x@other.example\n" if cls == "spam" else ""
            (d / f"{i}.eml").write_text(f"From: u{i}@corp.example\n{extra}Subject: s{i}\n\nbody\n")
    table, dropped = build_dataset(spark, str(tmp_path / "A"), "A", out_path=str(tmp_path / "out"))
    assert table.count() == 7 and "label" in table.columns and "has_from" in dropped
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    ds = prepare_datasets(spark, {"A": str(tmp_path / "A")}, n_ham=20, n_spam=20, synthetic=True)
    assert ds["A"].count() == 7 and ds["B"].count() == 20


@pytest.mark.parametrize("params", [{"calibration": "isotonic"}, {"calibration": "sigmoid", "calibration_cv": 3}])
def test_svm_calibrations(spark, params):
    a = generate_synthetic(spark, 120, 120, "A")
    cols = ["reply_to_present_and_differs", "spf_result", "n_received_hops", "x_spam_score"]
    p = MD.split_predictions(a, cols, "SVM", "A", "x", params={"n_components": 16, **params})
    m = M.classification_metrics(p, keys=["model_name"]).first()
    assert m["n"] == 48 and m["accuracy"] >= 0.8
    assert p.where("y_prob < 0 OR y_prob > 1").count() == 0


def test_missing_or_failing_corpus_raises(spark, tmp_path):
    import pytest
    from mailspark.plans.dataset import prepare_datasets
    with pytest.raises(FileNotFoundError):
        prepare_datasets(spark, {"A": str(tmp_path / "none")}, synthetic=True)
    (tmp_path / "empty" / "ham").mkdir(parents=True)
    with pytest.raises(Exception):
        prepare_datasets(spark, {"A": str(tmp_path / "empty")}, synthetic=True)
    with pytest.raises(ValueError):
        prepare_datasets(spark, {})


def test_mbox_keeps_every_message(spark, tmp_path):
    from mailspark.sources.mail import read_mbox, write_mbox
    (tmp_path / "phishing-1.txt").write_text("\nFrom a@b Thu\nSubject: one\n\nbody\n\nFrom c@d Fri\nSubject: two\n\nbody\n")
    got = read_mbox(spark, str(tmp_path / "phishing-*.txt")).orderBy("mail_id").collect()
    assert [r.raw.split("\n")[0] for r in got] == ["Subject: one", "Subject: two"]
    one = spark.createDataFrame([("Subject: x\n\nFrom here on\n>From there\n",)], "raw string")
    write_mbox(one.coalesce(1), str(tmp_path / "out"))
    assert read_mbox(spark, str(tmp_path / "out")).count() == 1


def test_number_coercion_takes_plain_numbers_only(spark):
    from pyspark.sql import functions as F
    from mailspark.functions import headers as H
    words = ["nan", "1d", "1f", "2.5", " -3e1 ", "true", "x", ".5", "7."]
    rows = spark.createDataFrame([(w,) for w in words], "v string").select("v", H.to_number(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 2.5, -30, 1, 0, 0.5, 7]
    nbsp = spark.createDataFrame([("\u00a0b.example\u00a0",)], "v string").select(H.pystrip(F.col("v")).alias("v")).first().v
    assert nbsp == "b.example"


def test_auth_repair_fields_and_id_in_text(spark):
    from mailspark.operators import compact as CP
    raw = ("From: a@b.c\nMessage-ID: <own@x>\nAuthentication-Results: h; spf=fail; dkim=pass\n\nin reply to <quoted@x> today\n")
    mails = spark.createDataFrame([("p1", raw, 1, 0)], "path string, raw string, mail_id long, label int")
    feats = CP.compact_features(mails.select("mail_id", "label", "path", "raw"))
    docs = CP.documents(feats.selectExpr("*", "cast(mail_id as string) as email_id"))
    from pyspark.sql import functions as F
    for mid, fixed in (("<own@x>", 1), ("<quoted@x>", 1), ("<other@x>", 0)):
        d = docs.withColumn("headers", F.col("headers").withField("message_id", F.lit(mid)))
        r = CP.repair_auth(d, mails).first()
        assert r.fixed == fixed
        if fixed:
            h = r.header_features
            assert (h.spf_result, h.dkim_result, h.dmarc_result, h.any_auth_fail, h.all_auth_pass, h.auth_results_present) == (-1, 1, 0, 1, 0, 1)


def test_spearman_joined_and_broadcast_ranks_agree(spark):
    from mailspark.operators.correlate import spearman_pairs
    rows = [(float(i % 7), float((i * 3) % 5) if i % 4 else None, 1.0, float("nan") if i % 6 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    out = [sorted((r.f1, r.f2, None if r.spearman is None else round(r.spearman, 9)) for r in spearman_pairs(df, list("abcd"), n).collect())
           for n in (0, 6, 1000)]
    assert out[0] == out[1] == out[2]
    got = {(a, b): v for a, b, v in out[0]}
    assert got["a", "c"] is None and len(got) == 6
    for a, b in (("a", "b"), ("a", "d"), ("b", "d")):
        both = df.toPandas()[[a, b]]
        # ranks of whole columns, pairs where both are present
        r = both.rank()
        assert abs(got[a, b] - r.corr().loc[a, b]) < 1e-9


def test_fold_stats_far_from_zero(spark):
    import numpy as np
    from mailspark.operators.folds import fold_stats
    rows = [(i % 3, 1e9 + i % 7, None if i % 5 == 0 else float(i), None) for i in range(60)]
    got = {r["fold"]: r for r in fold_stats(spark.createDataFrame(rows, "fold int, a double, b double, c double"), ["a", "b", "c"]).collect()}
    for f in range(3):
        for c, k in (("a", 1), ("b", 2)):
            x = np.array([r[k] for r in rows if r[0] != f and r[k] is not None])
            assert abs(got[f]["mean_" + c] - x.mean()) < 1e-6 and abs(got[f]["std_" + c] - x.std()) < 1e-6
        assert got[f]["mean_c"] is None and got[f]["std_c"] is None


def test_forests_have_the_librarys_full_depth(spark, monkeypatch):
    from mailspark import catalog
    levels, limits = [], []

    class Kept(MD.RandomForestClassifier):
        def fit(self, rows):
            model = super().fit(rows)
            limits.append(self.getMaxDepth())
            levels.append(max(t.depth for t in model.trees))
            return model
    monkeypatch.setattr(MD, "RandomForestClassifier", Kept)
    # labels without order over a fine grid: pure only far down
    noisy = spark.range(6000).select(F.col("id").alias("mail_id"), (F.xxhash64("id") % 2 == 0).cast("int").alias("label"),
                                     *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)).alias(c) for c in "abc"])
    MD.fit_predict("RF", noisy, noisy, list("abc")).count()
    assert levels[0] > 20
    catalog.queries()["rf_cv"](spark, "/root/testdata/sf0.001").count()
    assert limits == [30] * 6
    with pytest.raises(ValueError):
        MD.fit_predict("RF", noisy, noisy, list("abc"), {"maxDepth": 31})


@pytest.mark.parametrize("columns", [1, 6])
def test_knn_over_many_parts_equals_brute_force(spark, columns):
    import numpy as np
    rng = np.random.default_rng(1)
    # small whole numbers beside wide ones: exact ties, repeated points and distant ones
    x = np.column_stack([rng.integers(0, 1000, 700), *[rng.integers(0, 4, 700) for _ in range(columns - 1)]]).astype(float)
    x[:100] = x[100:200]
    label = rng.integers(0, 2, 700)
    cols = [f"c{i}" for i in range(columns)]
    df = spark.createDataFrame([(i, int(y), *map(float, r)) for i, (y, r) in enumerate(zip(label, x))],
                               "mail_id long, label int, " + ", ".join(c + " double" for c in cols))
    train, test = df.where("mail_id % 5 <> 0"), df.where("mail_id % 5 = 0")
    report = {}
    out = MD.knn_predict(train, test, cols, k=5, report=report, part=20, queries=15)
    got = {r.mail_id: r.y_prob for r in out.select("mail_id", "y_prob").collect()}
    assert report["parts"] >= 20 and 0 < report["share_met"] < (0.2 if columns == 1 else 0.9)
    fit = np.arange(700) % 5 != 0
    z = (x - x[fit].mean(axis=0)) / x[fit].std(axis=0)
    assert len(got) == 140
    for i in np.flatnonzero(~fit):
        d = np.round(np.sqrt(((z[fit] - z[i]) ** 2).sum(axis=1)), 9)
        cut = np.sort(d)[4]
        near, tied = d < cut, d == cut
        want = (label[fit][near].sum() + (5 - near.sum()) * label[fit][tied].mean()) / 5
        assert abs(got[i] - want) < 1e-9


def test_matrix_goes_on_from_its_ledger(spark, tmp_path, monkeypatch):
    """A cell that fails is recorded; the next run does only that one, and a changed setting runs anew."""
    a = generate_synthetic(spark, 60, 60, "A")
    real, ran = MD.cv_predictions, []

    def watched(df, cols, model, *args, **kw):
        ran.append(model)
        if model == "RF" and len(ran) <= 2:
            raise RuntimeError("executor lost")
        return real(df, cols, model, *args, **kw)
    monkeypatch.setattr(MD, "cv_predictions", watched)
    run = {"groups": ("G8",), "models": ("KNN", "RF"), "k": 2, "ledger": str(tmp_path / "ledger"),
           "params": {"RF": {"numTrees": 5, "maxDepth": 4}}}
    first = run_matrix(spark, {"A": a}, **run)
    assert [r.model_name for r in first["failures"].collect()] == ["RF"] and ran == ["KNN", "RF"]
    again = run_matrix(spark, {"A": a}, **run)
    assert ran == ["KNN", "RF", "RF"] and again["failures"].count() == 0
    assert {r.model_name for r in again["results"].collect()} == {"KNN", "RF"}
    assert again["predictions"].count() == 240
    run_matrix(spark, {"A": a}, **run)
    assert len(ran) == 3
    run_matrix(spark, {"A": a}, **{**run, "params": {"RF": {"numTrees": 6, "maxDepth": 4}}})
    assert ran[3:] == ["RF"]


def test_one_class_solver_reaches_the_optimum(spark):
    """Against many small dual steps over all rows at once."""
    import numpy as np
    from mailspark.operators import one_class
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").coalesce(3)
    fourier, nu = MD._fourier(3, 64, 0.3), 0.2
    w, history = one_class.solve(rows, ["a", "b", "c"], nu, fourier, gap=1e-3)
    z = fourier(x)
    best = z.mean(axis=0)
    for k in range(20_000):
        tail = z[np.argsort(z @ best)[:80]].mean(axis=0)
        best = best + 2 / (k + 2) * (tail - best)
    assert float(w @ w) <= float(best @ best) * 1.01 and float(w @ w) >= float(best @ best) * 0.98
    assert [h[1] for h in history] == sorted((h[1] for h in history), reverse=True)


def test_kernel_classifier_agrees_with_an_exact_fit(spark):
    """Predictions of the landmark map against the exact kernel machine, solved pair by pair."""
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 2))
    y = np.where((x ** 2).sum(axis=1) > 1.4, 1, -1)
    df = spark.createDataFrame([(i, int(v > 0), float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(y, x))],
                               "mail_id long, label int, a double, b double")
    train, test = df.where("mail_id < 160"), df.where("mail_id >= 160")
    got = MD.fit_predict("SVM", train, test, ["a", "b"], {"calibration_cv": 0}).orderBy("mail_id").collect()
    fit = (x[:160] - x[:160].mean(axis=0)) / x[:160].std(axis=0)
    new = (x[160:] - x[:160].mean(axis=0)) / x[:160].std(axis=0)
    k, t = MD._kernel(fit, fit, 0.5), y[:160].astype(float)
    a, g = np.zeros(160), -np.ones(160)
    for _ in range(20_000):  # the pair that breaks the conditions most
        up, low = (t > 0) & (a < 1) | (t < 0) & (a > 0), (t > 0) & (a > 0) | (t < 0) & (a < 1)
        i, j = int(np.where(up, -t * g, -np.inf).argmax()), int(np.where(low, -t * g, np.inf).argmin())
        if -t[i] * g[i] + t[j] * g[j] < 1e-4:
            break
        step = (-t[i] * g[i] + t[j] * g[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, 1 - a[i] if t[i] > 0 else a[i], a[j] if t[j] > 0 else 1 - a[j])
        a[i] += t[i] * step
        a[j] -= t[j] * step
        g += t * (k[:, i] - k[:, j]) * step
    bias = (-t * g)[(a > 1e-6) & (a < 1 - 1e-6)].mean()
    exact = MD._kernel(new, fit, 0.5) @ (a * t) + bias
    raw = np.array([r.y_prob for r in got])
    assert np.mean((raw > 0.5) == (exact > 0)) >= 0.98


def test_landmarks_explain_every_row():
    import numpy as np
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(40, 3)), np.repeat(rng.normal(size=(1, 3)), 60, axis=0)])
    chosen = MD.choose_landmarks(rows, 200, 0.3)
    assert len(chosen) == len(set(chosen.tolist())) <= 41
    k = MD._kernel(rows[chosen], rows[chosen], 0.3)
    c = MD._kernel(rows, rows[chosen], 0.3)
    assert np.abs(c @ np.linalg.solve(k + 1e-12 * np.eye(len(k)), c.T) - MD._kernel(rows, rows, 0.3)).max() < 1e-3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1023, 4096])
def test_keyed_shuffle_is_a_bijection(spark, n):
    from mailspark.operators import permute
    went = [r[0] for r in spark.range(n).select(permute.shuffled(F.col("id"), n, permute.keys(7, 2))).collect()]
    assert sorted(went) == list(range(n))
    assert n < 100 or sum(a == b for a, b in enumerate(went)) < n / 10


def test_labels_come_from_the_folder_below_the_root(spark, tmp_path):
    flat = tmp_path / "spam" / "flat"
    for at in (flat, flat / "ham", flat / "deep" / "phishing"):
        at.mkdir(parents=True, exist_ok=True)
        (at / "m.eml").write_bytes(b"Subject: x\r\n\r\nSubject: body\r\n")
    (flat / "empty.eml").write_bytes(b"")
    (flat / "noise.eml").write_bytes(bytes(range(256)))
    rows = ML.read_mail_dir(spark, str(flat)).collect()
    # the source has no row for a file without bytes
    assert len(rows) == len({r.mail_id for r in rows}) == 4 and {r.label for r in rows} == {0}
    up = {r.path.rsplit("/", 2)[-2]: r.label for r in ML.read_mail_dir(spark, str(tmp_path)).collect()}
    assert set(up.values()) == {1}
    wild = ML.read_mail_dir(spark, str(tmp_path / "sp*" / "fl?t")).collect()
    assert {r.label for r in wild} == {0}


@pytest.mark.parametrize("raw,names", [
    ("A: 1\r\nB: 2\r\n\r\nC: 3", ["a", "b"]), ("A: 1\nB: 2\n\nC: 3\r\n\r\nD: 4", ["a", "b"]), ("A: 1\r\nB: 2\r\n", ["a", "b"]),
    ("\r\nA: 1\r\n\r\n", []), ("\n\nA: 1", []), ("A: 1\n\r\nB: 2", ["a"]), ("A: 1\r\n\nB: 2", ["a"]), ("", []), ("A: 1\r", ["a"])])
def test_header_block_ends_at_the_first_empty_line(spark, raw, names):
    from mailspark.functions import headers as H
    got = spark.createDataFrame([(raw,)], "raw string").select(H.header_arrays(F.col("raw")).alias("h")).first().h
    assert got.names_lc == names and all("\r\n" not in v for v in got["values"])
