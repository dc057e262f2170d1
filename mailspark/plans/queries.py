"""The registered queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailspark import oracle as O
from mailspark.catalog import register
from mailspark.functions import headers as H
from mailspark.operators import wide as W
from mailspark.sources import fixtures as fx

# --------------------------------------------------------------------------
# Header split and lookups over the derived raw_mail
# --------------------------------------------------------------------------


@register("header_split", O.header_split_sql())
def q_header_split(spark, sf):
    rm = fx.raw_mail(spark, sf)
    h = rm.select("mail_id", F.explode(H.split_headers(F.col("raw"))).alias("h"))
    return h.select("mail_id", F.col("h.pos").cast("int").alias("pos"), F.col("h.name_lc").alias("name_lc"),
                    F.length("h.value").cast("int").alias("value_len"), F.col("h.value").alias("value"))


@register("header_first", O.mail_prefix() +
          "SELECT mail_id, v_from AS from_value, v_subject AS subject, v_mid AS message_id, "
          "v_date AS date_value FROM hv")
def q_header_first(spark, sf):
    rm = fx.raw_mail(spark, sf)
    h = rm.select("mail_id", H.split_headers(F.col("raw")).alias("hd"))
    return h.select("mail_id", H.header_first(F.col("hd"), "From").alias("from_value"),
                    H.header_first(F.col("hd"), "Subject").alias("subject"),
                    H.header_first(F.col("hd"), "Message-ID").alias("message_id"),
                    H.header_first(F.col("hd"), "Date").alias("date_value"))


@register("header_all", O.mail_prefix() +
          "SELECT mail_id, CAST(len(recv) AS INTEGER) AS n_received, "
          "array_to_string(recv, '|') AS received_joined FROM hv")
def q_header_all(spark, sf):
    rm = fx.raw_mail(spark, sf)
    h = rm.select("mail_id", H.header_all(H.split_headers(F.col("raw")), "Received").alias("recv"))
    return h.select("mail_id", F.size("recv").cast("int").alias("n_received"),
                    F.array_join("recv", "|").alias("received_joined"))


# --------------------------------------------------------------------------
# 2.C wide features, by group and whole
# --------------------------------------------------------------------------

def _wide(cols):
    def build(spark, sf):
        return W.wide_features(fx.raw_mail(spark, sf), columns=cols)
    return build


for _name, _cols in (("presence_features", W.G1_COLUMNS),
                     ("domain_features", W.G2_COLUMNS),
                     ("routing_features", W.G3_COLUMNS),
                     ("structural_features", W.G4_COLUMNS),
                     ("auth_features", W.G5_COLUMNS),
                     ("misc_features", W.MISC_COLUMNS),
                     ("wide_features", W.WIDE_FEATURES)):
    register(_name, O.wide_sql(_cols))(_wide(_cols))


# --------------------------------------------------------------------------
# 2.H metrics over the derived `scored` predictions
# --------------------------------------------------------------------------
from mailspark.operators import metrics as M  # noqa: E402

_K = "dataset, feature_group, model_name, fold"
_SC = O.prefix_for("scored")


@register("classification_metrics", _SC + f"""
SELECT {_K}, n, round(round(accuracy, 12), 6) AS accuracy,
       round(round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 12), 6) AS precision,
       round(round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 12), 6) AS recall,
       round(round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 12), 6) AS f1,
       round(round(brier_score, 12), 6) AS brier_score, round(round(mean_confidence, 12), 6) AS mean_confidence,
       round(round(positive_rate, 12), 6) AS positive_rate
FROM (SELECT {_K}, CAST(count(*) AS BIGINT) AS n,
             CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
             avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy,
             avg((y_prob - y_true) * (y_prob - y_true)) AS brier_score,
             avg(y_prob) AS mean_confidence, avg(CAST(y_true AS DOUBLE)) AS positive_rate
      FROM scored GROUP BY {_K}) t""")
def q_classification_metrics(spark, sf):
    return M.rounded(M.classification_metrics(fx.scored(spark, sf)), settle=12)


@register("brier", _SC + f"SELECT {_K}, round(avg((y_prob - y_true) * (y_prob - y_true)), 6) AS brier_score "
                         f"FROM scored GROUP BY {_K}")
def q_brier(spark, sf):
    return M.rounded(M.brier(fx.scored(spark, sf)))


def _auc_sql(keys: str) -> str:
    return _SC + f"""
, g AS (SELECT {keys}, y_prob, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg
        FROM scored GROUP BY {keys}, y_prob),
r AS (SELECT *, coalesce(sum(pos + neg) OVER (PARTITION BY {keys} ORDER BY y_prob
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
a AS (SELECT {keys}, sum(pos * (before + (pos + neg + 1) / 2.0)) AS rsum, sum(pos) AS p, sum(neg) AS n
      FROM r GROUP BY {keys})
SELECT {keys}, round(round(CASE WHEN p > 0 AND n > 0 THEN (rsum - p * (p + 1) / 2.0) / (p * n) END, 12), 6) AS auc FROM a"""


@register("roc_auc", _auc_sql(_K))
def q_roc_auc(spark, sf):
    return M.rounded(M.roc_auc(fx.scored(spark, sf)), settle=12)


@register("roc_auc_by_model", _auc_sql("dataset, model_name"))
def q_roc_auc_by_model(spark, sf):
    return M.rounded(M.roc_auc(fx.scored(spark, sf), keys=["dataset", "model_name"]), settle=12)


@register("average_precision", _SC + f"""
, g AS (SELECT {_K}, y_prob, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg
        FROM scored GROUP BY {_K}, y_prob),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
      WINDOW w AS (PARTITION BY {_K} ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT {_K}, round(CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END, 6) AS average_precision
FROM r GROUP BY {_K}""")
def q_average_precision(spark, sf):
    return M.rounded(M.average_precision(fx.scored(spark, sf)))


def _edge(k: str, n: int = 10) -> str:
    return f"(CASE WHEN {k} >= {n} THEN 1.0 ELSE CAST({k} AS DOUBLE) * (1.0 / {n}) END)"


_B0 = "CAST(least(greatest(floor(y_prob * 10), 0), 9) AS INTEGER)"
_ECE_BIN = (f"CASE WHEN y_prob >= 0 AND y_prob < 1.0 THEN (CASE WHEN y_prob < {_edge('b0')} THEN b0 - 1 "
            f"WHEN y_prob >= {_edge('b0 + 1')} THEN b0 + 1 ELSE b0 END) END")


@register("ece", _SC + f"""
, b AS (SELECT {_K}, y_true, y_prob, {_ECE_BIN} AS bin FROM (SELECT *, {_B0} AS b0 FROM scored) s),
pb AS (SELECT {_K}, bin, count(*) AS cnt, sum(y_true) AS sy, sum(y_prob) AS sp FROM b GROUP BY {_K}, bin)
SELECT {_K}, round(round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(sp - sy) END), 0.0) / sum(cnt), 12), 6) AS ece
FROM pb GROUP BY {_K}""")
def q_ece(spark, sf):
    return M.rounded(M.ece(fx.scored(spark, sf)), settle=12)


_RB0 = "CAST(least(greatest(ceil(y_prob * 10) - 1, 0), 9) AS INTEGER)"
_REL_BIN = (f"CASE WHEN b0 > 0 AND y_prob <= {_edge('b0')} THEN b0 - 1 "
            f"WHEN b0 < 9 AND y_prob > {_edge('b0 + 1')} THEN b0 + 1 ELSE b0 END")


@register("reliability_curve", _SC + f"""
SELECT {_K}, bin, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS n_positive, round(round(sum(y_prob), 12), 6) AS sum_predicted,
       round(round(sum(y_true) / CAST(count(*) AS DOUBLE), 12), 6) AS fraction_of_positives,
       round(round(sum(y_prob) / count(*), 12), 6) AS mean_predicted
FROM (SELECT *, {_REL_BIN} AS bin FROM (SELECT *, {_RB0} AS b0 FROM scored) s) t GROUP BY {_K}, bin""")
def q_reliability_curve(spark, sf):
    return M.rounded(M.reliability_curve(fx.scored(spark, sf)), settle=12)


@register("score_histogram", _SC + """
, rng AS (SELECT y_true, CASE WHEN max(y_prob) = min(y_prob) THEN min(y_prob) - 0.5 ELSE min(y_prob) END AS lo,
                 CASE WHEN max(y_prob) = min(y_prob) THEN max(y_prob) + 0.5 ELSE max(y_prob) END AS hi
          FROM scored GROUP BY y_true),
j AS (SELECT s.y_true, s.y_prob, r.lo, r.hi, (r.hi - r.lo) / 30 AS step,
             CAST(trunc((s.y_prob - r.lo) * (30 / (r.hi - r.lo))) AS INTEGER) AS b FROM scored s JOIN rng r USING (y_true)),
k AS (SELECT *, CASE WHEN b = 30 THEN 29 ELSE b END AS b0 FROM j),
e AS (SELECT *, CASE WHEN y_prob < (CASE WHEN b0 >= 30 THEN hi ELSE b0 * step + lo END) THEN b0 - 1
                     WHEN y_prob >= (CASE WHEN b0 + 1 >= 30 THEN hi ELSE (b0 + 1) * step + lo END) AND b0 <> 29 THEN b0 + 1
                     ELSE b0 END AS bin FROM k)
SELECT y_true, bin, count(*) AS n, round(first(CASE WHEN bin >= 30 THEN hi ELSE bin * step + lo END), 6) AS bin_lo
FROM e GROUP BY y_true, bin""")
def q_score_histogram(spark, sf):
    return M.rounded(M.score_histogram(fx.scored(spark, sf)))


@register("confidence_rows", _SC + """
SELECT mail_id AS email_idx, y_true, y_pred, y_prob AS confidence, CAST(y_true = y_pred AS INTEGER) AS correct,
       model_name AS model, feature_group FROM scored""")
def q_confidence_rows(spark, sf):
    return M.confidence_rows(fx.scored(spark, sf))


# --------------------------------------------------------------------------
# A2/E1/E10 corpus, 2.E cleaning, G1m-G3m folds, 2.J correlation
# --------------------------------------------------------------------------
from mailspark.operators import clean as C  # noqa: E402
from mailspark.operators import correlate as J  # noqa: E402
from mailspark.operators import folds as FO  # noqa: E402
from mailspark.operators.numbering import row_number_by  # noqa: E402

_FM = O.prefix_for("feature_matrix")
_RM = O.prefix_for("raw_mail")
CLASS_CAP = 2000  # max mails per class (the operator's parameter)


@register("label_counts", _FM + "SELECT label, count(*) AS n FROM feature_matrix GROUP BY label")
def q_label_counts(spark, sf):
    return C.label_counts(fx.feature_matrix(spark, sf))


@register("class_union", _RM + "SELECT label, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS bytes "
                              "FROM raw_mail GROUP BY label")
def q_class_union(spark, sf):
    rm = fx.raw_mail(spark, sf)
    parts = [rm.where(F.col("label") == v) for v in (0, 1)]
    u = parts[0].unionByName(parts[1])
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).cast("long").alias("bytes"))


@register("class_cap", _RM + f"""
SELECT mail_id, label, path, rn FROM (
  SELECT mail_id, label, path, row_number() OVER (PARTITION BY label ORDER BY path) AS rn FROM raw_mail) t
WHERE rn <= {CLASS_CAP}""")
def q_class_cap(spark, sf):
    rm = fx.raw_mail(spark, sf).select("mail_id", "label", "path")
    return row_number_by(rm, ["label"], ["path"], out="rn").where(F.col("rn") <= CLASS_CAP)


_FM_NUM = fx.FEATURE_MATRIX_FEATURES


@register("impute_median", _FM + """
SELECT mail_id, round(coalesce(subject_len, (SELECT quantile_cont(subject_len, 0.5) FROM feature_matrix)), 6)
       AS subject_len FROM feature_matrix""")
def q_impute_median(spark, sf):
    fm = fx.feature_matrix(spark, sf)
    return M.rounded(C.impute_median(fm, ["subject_len"]).select("mail_id", "subject_len"))


def _clip_sql() -> str:
    cols = C.count_columns(_FM_NUM, "reference")
    imp = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM feature_matrix)) AS {c}" for c in cols)
    caps = ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in cols)
    sel = ", ".join(f"round(least({c}, cap_{c}), 6) AS {c}" for c in cols)
    return _FM + f", imp AS (SELECT mail_id, {imp} FROM feature_matrix), caps AS (SELECT {caps} FROM imp)\n" \
                 f"SELECT mail_id, {sel} FROM imp, caps"


@register("clip_p99", _clip_sql())
def q_clip_p99(spark, sf):
    fm = fx.feature_matrix(spark, sf)
    cols = C.count_columns(_FM_NUM, "reference")
    return M.rounded(C.clip_p99(C.impute_median(fm, cols), cols).select("mail_id", *cols))


def _drop_constant_sql() -> str:
    cols = [c for c in ["subject_len", "n_received_hops", "mid_len", "spf_result", "has_reply_to",
                        "from_non_ascii", "has_from", "raw_status"]]
    parts = [f"SELECT '{c}' AS column_name FROM feature_matrix HAVING min({c}) IS NULL OR min({c}) = max({c})"
             for c in cols]
    return _FM + " UNION ALL ".join(parts)


@register("drop_constant", _drop_constant_sql())
def q_drop_constant(spark, sf):
    fm = C.drop_metadata(fx.feature_matrix(spark, sf)).drop("mail_id")
    const = C.constant_columns(fm)
    # driver-side list of names (bounded by the schema), returned as a relation
    return spark.createDataFrame([(c,) for c in const], "column_name string")


@register("label_encode", _FM + "SELECT mail_id, raw_status, CAST(dense_rank() OVER (ORDER BY raw_status) - 1 AS INTEGER)"
                              " AS raw_status_code FROM feature_matrix")
def q_label_encode(spark, sf):
    fm = fx.feature_matrix(spark, sf).select("mail_id", "raw_status")
    enc = C.label_encode(fm.withColumn("raw_status_code", F.col("raw_status")), ["raw_status_code"])
    return enc


_FOLD_SQL = ("CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(mail_id AS VARCHAR) || '42'), mail_id) - 1)"
             " % 5 AS INTEGER)")


@register("stratified_folds", _FM + f"SELECT mail_id, label, {_FOLD_SQL} AS fold FROM feature_matrix")
def q_stratified_folds(spark, sf):
    return FO.stratified_folds(fx.feature_matrix(spark, sf).select("mail_id", "label"), k=5, seed=42)


@register("holdout_split", _FM + """
SELECT mail_id, label, CAST(rn <= ceil(n * 0.2) AS INTEGER) AS is_test FROM (
  SELECT mail_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(mail_id AS VARCHAR) || '42'), mail_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM feature_matrix) t""")
def q_holdout_split(spark, sf):
    return FO.holdout_split(fx.feature_matrix(spark, sf).select("mail_id", "label"), 0.2, 42)


_SCALE_COLS = [c for c in _FM_NUM if c != "subject_len"]  # that one has nulls


def _scale_sql() -> str:
    per = ", ".join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in _SCALE_COLS)
    tot = ", ".join(f"sum(s_{c}) OVER () AS st_{c}, sum(q_{c}) OVER () AS qt_{c}" for c in _SCALE_COLS)
    stats = ", ".join(
        f"(st_{c} - s_{c}) / (ntot - nn) AS mean_{c}, "
        f"sqrt(greatest((qt_{c} - q_{c}) / (ntot - nn) - ((st_{c} - s_{c}) / (ntot - nn)) ^ 2, 0.0)) AS std_{c}"
        for c in _SCALE_COLS)
    sel = ", ".join(f"round(round(({c} - mean_{c}) / CASE WHEN std_{c} = 0 THEN 1.0 ELSE std_{c} END, 12), 6) AS {c}"
                    for c in _SCALE_COLS)
    return _FM + f""", f AS (SELECT *, {_FOLD_SQL} AS fold FROM feature_matrix),
per AS (SELECT fold, count(*) AS nn, {per} FROM f GROUP BY fold),
tot AS (SELECT *, sum(nn) OVER () AS ntot, {tot} FROM per),
st AS (SELECT fold, {stats} FROM tot)
SELECT mail_id, fold, {sel} FROM f JOIN st USING (fold)"""


@register("standard_scale", _scale_sql())
def q_standard_scale(spark, sf):
    fm = FO.stratified_folds(fx.feature_matrix(spark, sf), k=5, seed=42)
    return M.rounded(FO.standard_scale(fm, _SCALE_COLS).select("mail_id", "fold", *_SCALE_COLS), settle=12)


def _scale_all_sql() -> str:
    st = ", ".join(f"avg(f.{c}) AS mean_{c}, sqrt(var_pop(f.{c})) AS std_{c}" for c in _FM_NUM)
    sel = ", ".join(f"round(round(({c} - mean_{c}) / CASE WHEN std_{c} = 0 THEN 1.0 ELSE std_{c} END, 12), 6) AS {c}"
                    for c in _FM_NUM)
    return _FM + f""", f AS (SELECT *, {_FOLD_SQL} AS fold FROM feature_matrix),
k AS (SELECT DISTINCT fold FROM f),
st AS (SELECT k.fold, {st} FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold)
SELECT mail_id, fold, {sel} FROM f JOIN st USING (fold)"""


@register("standard_scale_all", _scale_all_sql())
def q_standard_scale_all(spark, sf):
    """With subject_len: statistics of the values that are not null, squares from the mean."""
    fm = FO.stratified_folds(fx.feature_matrix(spark, sf), k=5, seed=42)
    return M.rounded(FO.standard_scale(fm, _FM_NUM).select("mail_id", "fold", *_FM_NUM), settle=12)


_CORR_COLS = ["subject_len", "n_received_hops", "mid_len", "spf_result", "has_reply_to", "from_non_ascii"]


def _imputed_fm_sql() -> str:
    imp = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM feature_matrix)) AS {c}"
                    for c in _CORR_COLS)
    return _FM + f", imp AS (SELECT mail_id, label, {imp} FROM feature_matrix)"


def _spearman_sql() -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
                      for c in _CORR_COLS)
    pairs = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
    sel = " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, corr(r_{a}, r_{b}) AS s FROM rk" for a, b in pairs)
    return _imputed_fm_sql() + f""", rk AS (SELECT {ranks} FROM imp), c AS ({sel})
SELECT f1, f2, round(round(CASE WHEN isnan(s) THEN NULL ELSE s END, 12), 6) AS spearman,
       round(round(1.0 - abs(CASE WHEN isnan(s) THEN NULL ELSE s END), 12), 6) AS distance FROM c"""


@register("spearman_pairs", _spearman_sql())
def q_spearman_pairs(spark, sf):
    fm = C.impute_median(fx.feature_matrix(spark, sf), _CORR_COLS)
    return M.rounded(J.spearman_pairs(fm, _CORR_COLS), settle=12)


@register("class_means", _imputed_fm_sql() + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CASE WHEN label = 0 THEN {c} END), 6) AS mean_ham, "
    f"round(avg(CASE WHEN label = 1 THEN {c} END), 6) AS mean_spam FROM imp" for c in _CORR_COLS))
def q_class_means(spark, sf):
    fm = C.impute_median(fx.feature_matrix(spark, sf), _CORR_COLS)
    return M.rounded(J.class_means(fm, _CORR_COLS))


# --------------------------------------------------------------------------
# 2.K report analytics over results derived from `scored` (H10 -> H12)
# --------------------------------------------------------------------------
from mailspark.operators import report as R  # noqa: E402

_RES_METRICS = M.METRICS
_RES_SQL = _SC + f"""
, ag AS (SELECT {_K}, y_prob, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg
        FROM scored GROUP BY {_K}, y_prob),
ar AS (SELECT *, coalesce(sum(pos + neg) OVER (PARTITION BY {_K} ORDER BY y_prob
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ag),
au AS (SELECT {_K}, CASE WHEN p > 0 AND n > 0 THEN (rsum - p * (p + 1) / 2.0) / (p * n) END AS auc
       FROM (SELECT {_K}, sum(pos * (before + (pos + neg + 1) / 2.0)) AS rsum, sum(pos) AS p, sum(neg) AS n FROM ar GROUP BY {_K}) t),
eb AS (SELECT {_K}, y_true, y_prob, {_ECE_BIN} AS bin FROM (SELECT *, {_B0} AS b0 FROM scored) s),
ep AS (SELECT {_K}, bin, count(*) AS cnt, sum(y_true) AS sy, sum(y_prob) AS sp FROM eb GROUP BY {_K}, bin),
ec AS (SELECT {_K}, coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(sp - sy) END), 0.0) / sum(cnt) AS ece FROM ep GROUP BY {_K}),
fc AS (SELECT {_K}, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
         avg((y_prob - y_true) * (y_prob - y_true)) AS brier_score
  FROM (SELECT *, CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) OVER c AS DOUBLE) AS tp,
               CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) OVER c AS DOUBLE) AS fp,
               CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) OVER c AS DOUBLE) AS fn
        FROM scored WINDOW c AS (PARTITION BY {_K})) s
  GROUP BY {_K}, tp, fp, fn),
fm AS (SELECT * FROM fc JOIN au USING ({_K}) JOIN ec USING ({_K})),
res AS (SELECT dataset, feature_group, model_name, {", ".join(f"avg({m}) AS {m}" for m in _RES_METRICS)},
        row_number() OVER (ORDER BY dataset, feature_group, model_name) AS pos
        FROM fm GROUP BY dataset, feature_group, model_name),
paper AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{m}', CAST({a} AS DOUBLE), CAST({f} AS DOUBLE))" for d, m, a, f in R.PAPER_BASELINE)})
          t(dataset, model_name, accuracy, f1))
"""


def _results(spark, sf):
    fm = M.all_metrics(fx.scored(spark, sf))
    return M.fold_summary(fm, metrics=_RES_METRICS).drop(*[m + "_std" for m in _RES_METRICS], "n_folds")


_SUMMARY = ", ".join(f"round(round(avg({m}), 12), 6) AS {m}, round(round(stddev_pop({m}), 12), 6) AS {m}_std" for m in _RES_METRICS)


@register("fold_summary", _RES_SQL + f"""
SELECT dataset, feature_group, model_name, {_SUMMARY}, count(DISTINCT fold) AS n_folds
FROM fm GROUP BY dataset, feature_group, model_name""")
def q_fold_summary(spark, sf):
    fm = M.all_metrics(fx.scored(spark, sf))
    return M.rounded(M.fold_summary(fm, metrics=_RES_METRICS), settle=12)


@register("extended_table", _RES_SQL + """
SELECT *, accuracy = max(accuracy) OVER (PARTITION BY dataset, model_name) AS is_best_accuracy
FROM (SELECT dataset, model_name, feature_group, """ + ", ".join(f"round(round({m}, 12), 4) AS {m}" for m in _RES_METRICS) + " FROM res) t")
def q_extended_table(spark, sf):
    return R.extended_table(_results(spark, sf))


@register("best_accuracy", _RES_SQL + """
, b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, pos) AS rn FROM res),
pb AS (SELECT dataset, max(accuracy) AS paper_best FROM paper GROUP BY dataset)
SELECT b.dataset, model_name, feature_group, round(b.accuracy, 6) AS accuracy, round(paper_best, 6) AS paper_best,
       round(b.accuracy - paper_best, 6) AS delta_vs_paper
FROM b LEFT JOIN pb ON upper(b.dataset) = pb.dataset WHERE rn = 1""")
def q_best_accuracy(spark, sf):
    return M.rounded(R.best_accuracy(_results(spark, sf), R.paper_baseline(spark)))


@register("calibration_extremes", _RES_SQL + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{kind}' AS kind, round(round({m}, 12), 6) AS value, model_name, feature_group, dataset FROM ("
    f"SELECT *, row_number() OVER (ORDER BY {m} {order}, pos) AS rn FROM res WHERE {m} IS NOT NULL) {m}_{kind} WHERE rn = 1"
    for m in ("brier_score", "ece") for kind, order in (("best", "ASC"), ("worst", "DESC"))))
def q_calibration_extremes(spark, sf):
    return M.rounded(R.calibration_extremes(_results(spark, sf)), settle=12)


@register("paper_delta", _RES_SQL + """
SELECT r.dataset, r.model_name, round(r.accuracy, 6) AS accuracy, round(r.f1, 6) AS f1,
       round(p.accuracy, 6) AS paper_accuracy, round(p.f1, 6) AS paper_f1,
       round(r.accuracy - p.accuracy, 6) AS delta_accuracy
FROM res r LEFT JOIN paper p ON upper(r.dataset) = p.dataset AND r.model_name = p.model_name
WHERE r.feature_group = 'G1'""")
def q_paper_delta(spark, sf):
    return M.rounded(R.paper_delta(_results(spark, sf), R.paper_baseline(spark), group="G1"))


@register("metric_pivot", _RES_SQL + """
SELECT feature_group, round(avg(CASE WHEN model_name = 'KNN' THEN accuracy END), 6) AS KNN,
       round(avg(CASE WHEN model_name = 'RF' THEN accuracy END), 6) AS RF FROM res GROUP BY feature_group""")
def q_metric_pivot(spark, sf):
    return M.rounded(R.metric_pivot(_results(spark, sf), "accuracy", models=["KNN", "RF"]))


@register("group_bars", _RES_SQL + """
SELECT feature_group, model_name, round(avg(f1), 6) AS f1 FROM res GROUP BY feature_group, model_name""")
def q_group_bars(spark, sf):
    return M.rounded(R.group_bars(_results(spark, sf), "f1"))


@register("best_per_dataset", _RES_SQL + "SELECT dataset, " + ", ".join(
    f"round(round(max({m}), 12), 6) AS best_{m}" for m in ("accuracy", "f1", "auc")) + " FROM res GROUP BY dataset")
def q_best_per_dataset(spark, sf):
    return M.rounded(R.best_per_dataset(_results(spark, sf)), settle=12)


@register("flagship_class_profile", O.mail_prefix() + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CASE WHEN label = 0 THEN {O.FEATURE_SQL[c]} END), 6) AS mean_ham, "
    f"round(avg(CASE WHEN label = 1 THEN {O.FEATURE_SQL[c]} END), 6) AS mean_spam FROM hd" for c in W.WIDE_FEATURES))
def q_flagship(spark, sf):
    from mailspark.plans.flagship import flagship
    return M.rounded(flagship(spark, sf))


# --------------------------------------------------------------------------
# 2.D compact features, A8 sniff filter, D5 documents
# --------------------------------------------------------------------------
from mailspark.operators import compact as CP  # noqa: E402


def _compact_sql() -> str:
    def strip(e):
        return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"

    def dec(name):  # unfold + strip (the fixture holds no encoded words)
        return strip(f"regexp_replace(coalesce({O._first(name)}, ''), '\\r?\\n([ \\t])', '\\1', 'g')")
    pres = ", ".join(f"CAST({O._present(h)} AS INTEGER) AS {c}" for c, h in CP._PRESENCE16.items())
    auth = dec("Authentication-Results")

    def tok(p):
        t = f"lower({strip(f'regexp_extract({auth}, ' + chr(39) + f'(?i){p}' + chr(92) + 's*=' + chr(92) + 's*(' + chr(92) + 'S+)' + chr(39) + ', 1)')})"
        return (f"CASE WHEN {auth} = '' THEN 0 WHEN contains({t}, 'pass') THEN 1 WHEN contains({t}, 'fail') OR "
                f"contains({t}, 'none') OR contains({t}, 'temperror') OR contains({t}, 'permerror') THEN -1 ELSE 0 END")
    sig = dec("DKIM-Signature")
    valid = " AND ".join(f"contains({sig}, '{t}')" for t in CP.DKIM_TAGS)
    mid = dec("Message-ID")
    date = dec("Date")
    subj = dec("Subject")
    return O.mail_prefix() + f"""
, c AS (SELECT mail_id, label, {pres},
  CAST(length({subj}) AS INTEGER) AS subject_len, CAST(len(recv) AS INTEGER) AS n_received_hops,
  CAST(contains(lower({dec('Content-Transfer-Encoding')}), 'base64') AS INTEGER) AS is_base64_encoded,
  CAST({date} <> '' AND try_strptime({date}, '%d %b %Y %H:%M:%S %z') IS NULL AS INTEGER) AS malformed_date,
  CAST({mid} <> '' AND NOT regexp_matches({mid}, '^<[^<>@\\s]+@[^<>@\\s]+>$') AS INTEGER) AS mid_malformed,
  CAST({tok('spf')} AS INTEGER) AS spf_result, CAST({tok('dkim')} AS INTEGER) AS dkim_result,
  CAST({tok('dmarc')} AS INTEGER) AS dmarc_result,
  CAST({O._present('DKIM-Signature')} AS INTEGER) AS dkim_signature_present,
  CAST(coalesce({O._first('DKIM-Signature')}, '') <> '' AND {valid} AS INTEGER) AS dkim_signature_valid_format,
  CAST({auth} <> '' AS INTEGER) AS auth_results_present, {date} AS date, {mid} AS message_id FROM hd)
SELECT *, CAST(auth_results_present = 1 AND spf_result = 1 AND dkim_result = 1 AND dmarc_result = 1 AS INTEGER)
          AS all_auth_pass,
       CAST(spf_result = -1 OR dkim_result = -1 OR dmarc_result = -1 AS INTEGER) AS any_auth_fail FROM c"""


@register("compact_features", _compact_sql())
def q_compact_features(spark, sf):
    return CP.compact_features(fx.raw_mail(spark, sf))


@register("mail_sniff", _RM + "SELECT mail_id, CAST(regexp_matches(lower(regexp_replace(split_part(raw, chr(10), 1),"
                              " '^\\s+|\\s+$', '', 'g')), '^(" + "|".join(CP.MAIL_PREFIXES) + ")') AS INTEGER)"
                              " AS is_mail FROM raw_mail")
def q_mail_sniff(spark, sf):
    rm = fx.raw_mail(spark, sf)
    return rm.select("mail_id", CP.is_mail_text(F.col("raw")).cast("int").alias("is_mail"))


@register("compact_json")
def q_compact_json(spark, sf):
    docs = CP.extract_folder(fx.raw_mail(spark, sf), start_index=1)
    return docs.select("email_id", F.to_json(F.struct(*docs.columns)).alias("json"))


# --------------------------------------------------------------------------
# 2.G models (rows-only checks: fitted models are compared by quality)
# --------------------------------------------------------------------------
from mailspark.operators import models as MD  # noqa: E402

_MODEL_COLS = ["subject_len", "n_received_hops", "mid_len", "spf_result", "has_reply_to", "from_non_ascii"]


def _cv(model, params=None):
    def build(spark, sf):
        fm = C.impute_median(fx.feature_matrix(spark, sf), _MODEL_COLS)
        folded = FO.stratified_folds(fm.select("mail_id", "label", *_MODEL_COLS), k=5, seed=42).checkpoint()
        return MD.cv_predictions(folded, _MODEL_COLS, model, "A", "G_fm", k=5, params=params)
    return build


register("rf_cv")(_cv("RF"))
register("svm_cv")(_cv("SVM"))
register("mlp_cv")(_cv("MLP"))
register("one_class_score")(_cv("OC_SVM"))


# --------------------------------------------------------------------------
# sources / sinks round trips, D6-D8, 2.L scoring
# --------------------------------------------------------------------------
from mailspark import sinks as SK  # noqa: E402
from mailspark.operators import score as SC  # noqa: E402
from mailspark.session import scratch_dir  # noqa: E402
from mailspark.sources import documents as DOC  # noqa: E402
from mailspark.sources import mail as ML  # noqa: E402

_COMPACT_SQL = _compact_sql()


@register("mbox_split", _RM + "SELECT label, raw || chr(10) AS raw FROM raw_mail")
def q_mbox_split(spark, sf):
    return _mbox_labelled(spark, sf, scratch_dir(spark, "mbox"))


def _mbox_labelled(spark, sf, d):
    # one archive folder per class, labels from the class (dataset B layout)
    rm = fx.raw_mail(spark, sf)
    parts = []
    for lab in (0, 1):
        sub = f"{d}/{'ham' if lab == 0 else 'phishing'}"
        ML.write_mbox(rm.where(F.col("label") == lab).select("raw"), sub)
        parts.append(ML.read_mbox(spark, sub, label=lab).select("label", "raw"))
    return parts[0].unionByName(parts[1])


@register("documents_roundtrip", "SELECT * EXCLUDE (mail_id, label) FROM (" + _COMPACT_SQL + ") q")
def q_documents_roundtrip(spark, sf):
    d = scratch_dir(spark, "docs")
    feats = CP.compact_features(fx.raw_mail(spark, sf)).withColumn("email_id", F.col("mail_id").cast("string"))
    SK.write_documents(CP.documents(feats), d)
    back = DOC.read_documents(spark, d, multiline=False)
    return back.select("header_features.*", F.col("headers.date").alias("date"),
                       F.col("headers.message_id").alias("message_id"))


@register("upgrade_documents", "SELECT mail_id, " + ", ".join(CP.HEADER16) + ", "
          + ", ".join(f"0 AS {c}" for c in CP.AUTH8) + ", 1 AS upgraded FROM (" + _COMPACT_SQL + ") q")
def q_upgrade_documents(spark, sf):
    feats = CP.compact_features(fx.raw_mail(spark, sf))
    old = feats.select("mail_id", F.struct(*[F.col(c) for c in CP.HEADER16],
                                           *[F.lit(None).cast("int").alias(c) for c in CP.AUTH8])
                       .alias("header_features"))
    up = CP.upgrade_documents(old)
    return up.select("mail_id", "header_features.*", "upgraded")


def _repair_sql() -> str:
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    auth = strip.format(f"regexp_replace(coalesce({O._first('Authentication-Results')}, ''), '\\r?\\n([ \\t])', '\\1', 'g')")

    def enc(p):
        t = f"regexp_extract({auth}, '(?i){p}\\s*=\\s*(\\S+)', 1)"
        return (f"CASE WHEN {t} = '' THEN NULL WHEN contains(lower({t}), 'pass') THEN 1 "
                f"WHEN contains(lower({t}), 'fail') OR contains(lower({t}), 'none') THEN -1 ELSE 0 END")
    mid = strip.format(f"regexp_replace(coalesce({O._first('Message-ID')}, ''), '\\r?\\n([ \\t])', '\\1', 'g')")
    return O.mail_prefix() + f"""
, fx AS (SELECT path, {mid} AS mid, {enc('spf')} AS s, {enc('dkim')} AS k, {enc('dmarc')} AS m,
         CAST({auth} <> '' AS INTEGER) AS arp, raw FROM hh),
ids AS (SELECT DISTINCT path, unnest(list_append(regexp_extract_all(raw, '<[^<>\\s]+@[^<>\\s]+>'), mid)) AS mid FROM fx),
first AS (SELECT i.mid, f.* EXCLUDE (mid) FROM (SELECT mid, min(path) AS path FROM ids WHERE mid <> '' GROUP BY mid) i
          JOIN fx f USING (path)),
docs AS ({_COMPACT_SQL})
SELECT CAST(d.mail_id AS VARCHAR) AS email_id,
       CASE WHEN f.path IS NULL THEN d.spf_result ELSE coalesce(f.s, 0) END AS spf_result,
       CASE WHEN f.path IS NULL THEN d.dkim_result ELSE coalesce(f.k, 0) END AS dkim_result,
       CASE WHEN f.path IS NULL THEN d.dmarc_result ELSE coalesce(f.m, 0) END AS dmarc_result,
       d.dkim_signature_present,
       CASE WHEN f.path IS NULL THEN d.auth_results_present ELSE f.arp END AS auth_results_present,
       CASE WHEN f.path IS NULL THEN d.any_auth_fail
            ELSE CAST(coalesce(f.s, 0) = -1 OR coalesce(f.k, 0) = -1 OR coalesce(f.m, 0) = -1 AS INTEGER) END AS any_auth_fail,
       CASE WHEN f.path IS NULL THEN d.all_auth_pass
            ELSE CAST(coalesce(f.s, 1) = 1 AND coalesce(f.k, 1) = 1 AND coalesce(f.m, 1) = 1 AS INTEGER) END AS all_auth_pass,
       CAST(f.path IS NOT NULL AS INTEGER) AS fixed
FROM docs d LEFT JOIN first f ON regexp_replace(d.message_id, '^\\s+|\\s+$', '', 'g') = f.mid"""


@register("repair_auth", _repair_sql())
def q_repair_auth(spark, sf):
    rm = fx.raw_mail(spark, sf)
    feats = CP.compact_features(rm).withColumn("email_id", F.col("mail_id").cast("string"))
    fixed = CP.repair_auth(CP.documents(feats), rm)
    return fixed.select("email_id", "header_features.spf_result", "header_features.dkim_result",
                        "header_features.dmarc_result", "header_features.dkim_signature_present",
                        "header_features.auth_results_present", "header_features.any_auth_fail",
                        "header_features.all_auth_pass", "fixed")


def _extracted(spark, sf):
    """The compact features of all mails, written once: a fit reads them several times and scoring
    once more, and each would extract them anew."""
    return CP.compact_features(fx.raw_mail(spark, sf)).checkpoint()


def _requests(spark, sf, feats=None):
    feats = CP.compact_features(fx.raw_mail(spark, sf)) if feats is None else feats
    return SC.documents_as_requests(CP.documents(feats.withColumn("email_id", F.col("mail_id").cast("string"))))


@register("request_features", "SELECT CAST(mail_id AS VARCHAR) AS email_id, "
          + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CP.COMPACT_FEATURES) + " FROM (" + _COMPACT_SQL + ") q")
def q_request_features(spark, sf):
    r = SC.request_features(_requests(spark, sf), CP.COMPACT_FEATURES)
    return r.select("email_id", *CP.COMPACT_FEATURES)


def _served_model(feats):
    """The model that is served, fitted on extracted features."""
    return MD.fit_pipeline(feats.select("label", *CP.COMPACT_FEATURES), CP.COMPACT_FEATURES, num_trees=100, max_depth=12, min_instances=3)


def _served(spark, sf):
    """Requests and the served model, from one extraction."""
    feats = _extracted(spark, sf)
    return _requests(spark, sf, feats), _served_model(feats)


@register("score_batch")
def q_score_batch(spark, sf):
    return SC.score_v1(*_served(spark, sf))


@register("score_dual")
def q_score_dual(spark, sf):
    return SC.score_v2(*_served(spark, sf), source_path="in-memory")


@register("detection_rate")
def q_detection_rate(spark, sf):
    return SC.detection_rate(SC.score_v1(*_served(spark, sf)))


# --------------------------------------------------------------------------
# 2.I importance (rows-only) and J2-J4 group correlation summaries
# --------------------------------------------------------------------------
from mailspark.operators import groups as GR  # noqa: E402
from mailspark.operators import importance as IM  # noqa: E402


def _imputed_fm(spark, sf):
    return C.impute_median(fx.feature_matrix(spark, sf), _MODEL_COLS)


def _fit_rows(spark, sf):
    """Labels and model columns, written once: a fit reads them several times."""
    return _imputed_fm(spark, sf).select("label", *_MODEL_COLS).checkpoint()


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    return IM.dataset_importance(_imputed_fm(spark, sf), _MODEL_COLS, "A", n_repeats=3)


@register("mdi_importance")
def q_mdi_importance(spark, sf):
    m = MD.fit_pipeline(_fit_rows(spark, sf), _MODEL_COLS, num_trees=100, max_depth=12, min_instances=3)
    return IM.mdi_importance(m, spark)


@register("feature_topk")
def q_feature_topk(spark, sf):
    m = MD.fit_pipeline(_fit_rows(spark, sf), _MODEL_COLS, num_trees=100, max_depth=12, min_instances=3)
    imp = IM.mdi_importance(m, spark)
    g8 = GR.group_columns("G8", _MODEL_COLS, imp)  # top-5 by importance
    return imp.where(F.col("feature").isin(g8))


def _positions(cols=_CORR_COLS):
    groups = {g: GR.group_columns(g, cols) for g in GR.GROUP_NAMES}
    rows, home, pos = [], {}, 0
    for g, feats in groups.items():
        for i, f in enumerate(feats):
            pos += 1
            home.setdefault(f, g)
            rows.append((g, i + 1, f, pos))
    return [(g, gp, f, p, home[f]) for g, gp, f, p in rows]


def _group_corr_sql(kind: str, spear: str | None = None, cols=_CORR_COLS) -> str:
    vals = ", ".join(f"('{g}', {gp}, '{f}', {p}, '{h}')" for g, gp, f, p, h in _positions(cols))
    spear = spear or _spearman_sql()
    head = spear[:spear.rindex("SELECT f1, f2")]
    pairs = ("sp AS (SELECT f1, f2, CASE WHEN isnan(s) THEN NULL ELSE s END AS s FROM c "
             "UNION ALL SELECT f2, f1, CASE WHEN isnan(s) THEN NULL ELSE s END FROM c), "
             f"pos AS (SELECT * FROM (VALUES {vals}) t(feature_group, gpos, feature, pos, first_group))")
    if kind == "within":
        return head + ", " + pairs + """,
tri AS (SELECT a.feature_group, b.gpos AS j, abs(sp.s) AS r FROM pos a JOIN pos b
        ON a.feature_group = b.feature_group AND a.gpos < b.gpos LEFT JOIN sp ON sp.f1 = a.feature AND sp.f2 = b.feature),
cm AS (SELECT feature_group, j, avg(r) AS m FROM tri GROUP BY feature_group, j),
wg AS (SELECT feature_group, avg(m) AS w FROM cm GROUP BY feature_group),
sz AS (SELECT feature_group, count(*) AS n_features FROM pos GROUP BY feature_group)
SELECT sz.feature_group, sz.n_features, round(CASE WHEN n_features >= 2 THEN w END, 6) AS within_corr
FROM sz LEFT JOIN wg USING (feature_group)"""
    return head + ", " + pairs + """
SELECT round(avg(abs(sp.s)), 6) AS between_corr, count(*) AS n_pairs FROM pos a JOIN pos b
  ON a.pos < b.pos AND a.first_group <> b.first_group LEFT JOIN sp ON sp.f1 = a.feature AND sp.f2 = b.feature"""


def _pairs_and_positions(spark, sf):
    fm = C.impute_median(fx.feature_matrix(spark, sf), _CORR_COLS)
    pairs = J.spearman_pairs(fm, _CORR_COLS)
    groups = {g: GR.group_columns(g, _CORR_COLS) for g in GR.GROUP_NAMES}
    return pairs, J.group_positions(spark, groups, _CORR_COLS)


@register("within_group_corr", _group_corr_sql("within"))
def q_within_group_corr(spark, sf):
    return M.rounded(J.within_group_corr(*_pairs_and_positions(spark, sf)))


@register("between_group_corr", _group_corr_sql("between"))
def q_between_group_corr(spark, sf):
    return M.rounded(J.between_group_corr(*_pairs_and_positions(spark, sf)))


# --------------------------------------------------------------------------
# G10m KNN: exact neighbours; the oracle is a brute-force distance table
# --------------------------------------------------------------------------
_KNN_COLS = ["n_received_hops", "mid_len", "spf_result"]


def _knn_sql(cols=_KNN_COLS, head: str = _FM, source: str = "feature_matrix") -> str:
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    sc = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}" for c in cols)
    dist = " + ".join(f"pow(q.{c} - t.{c}, 2)" for c in cols)
    take = "least(n, greatest(5 - (cum - n), 0))"
    return head + f""", f AS (SELECT *, {_FOLD_SQL} AS fold FROM {source}),
st AS (SELECT {st} FROM f WHERE fold <> 0),
tr AS (SELECT label, {sc} FROM f, st WHERE fold <> 0),
te AS (SELECT mail_id, {sc} FROM f, st WHERE fold = 0),
dd AS (SELECT q.mail_id, round(sqrt({dist}), 9) AS d, count(*) AS n, sum(t.label) AS pos
       FROM te q, tr t GROUP BY q.mail_id, d),
w AS (SELECT *, sum(n) OVER (PARTITION BY mail_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM dd)
SELECT mail_id, round(sum({take} * pos / n) / sum({take}), 6) AS y_prob FROM w GROUP BY mail_id"""


@register("knn_predict", _knn_sql())
def q_knn_predict(spark, sf):
    folded = FO.stratified_folds(fx.feature_matrix(spark, sf).select("mail_id", "label", *_KNN_COLS), k=5, seed=42).checkpoint()
    out = MD.knn_predict(folded.where("fold <> 0"), folded.where("fold = 0"), _KNN_COLS, k=5)
    return M.rounded(out.select("mail_id", "y_prob"))


@register("knn_predict_wide", _knn_sql(_MODEL_COLS, _imputed_fm_sql(), "imp"))
def q_knn_predict_wide(spark, sf):
    """The six model columns: nearly a point per mail, so several blocks from sf0.01 on."""
    folded = FO.stratified_folds(_imputed_fm(spark, sf).select("mail_id", "label", *_MODEL_COLS), k=5, seed=42).checkpoint()
    out = MD.knn_predict(folded.where("fold <> 0"), folded.where("fold = 0"), _MODEL_COLS, k=5)
    return M.rounded(out.select("mail_id", "y_prob"))


register("knn_cv")(_cv("KNN"))


@register("score_stream")
def q_score_stream(spark, sf):
    """Request files scored by a Structured Streaming query (available-now
    trigger, checkpointed); returns what the stream wrote."""
    from mailspark.streaming.score_stream import start_scoring
    in_dir, out_dir, ck = (scratch_dir(spark, x) for x in ("requests", "scored", "stream-ck"))
    requests, model = _served(spark, sf)
    # the text of requests is many times as large as what it holds
    requests.write.option("compression", "gzip").json(in_dir)
    q = start_scoring(spark, model, in_dir, out_dir, ck, multiline=False)
    q.awaitTermination()
    return spark.read.parquet(out_dir)


@register("rfecv")
def q_rfecv(spark, sf):
    """I4: recursive elimination with 5-fold CV (50-tree forests), the score per size."""
    _, table = IM.rfecv(_imputed_fm(spark, sf), _MODEL_COLS, k=5, step=1, min_features=1, num_trees=50)
    return table


# --------------------------------------------------------------------------
# E2-E9 as one step, F1-F7 and F10, H13, J4, K3, K6, K10, K11, K13
# --------------------------------------------------------------------------
def _cleaned_sql(source: str, cols: list[str], mode: str, codes: str = "") -> str:
    """CTEs ``imp``, ``caps``, ``fin`` over ``source``: imputed, clipped, encoded."""
    clipped = C.count_columns(cols, mode)
    imp = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {source})) AS {c}" for c in cols)
    caps = ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in clipped)
    sel = ", ".join(f"CAST(least({c}, cap_{c}) AS DOUBLE) AS {c}" if c in clipped else f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (f", imp AS MATERIALIZED (SELECT mail_id, label, {imp}{codes} FROM {source}), caps AS (SELECT {caps} FROM imp), "
            f"fin AS MATERIALIZED (SELECT mail_id, label, {sel}{', raw_status' if codes else ''} FROM imp, caps)\n")


def _clean_rows_sql(mode: str) -> str:
    code = ", CAST(dense_rank() OVER (ORDER BY coalesce(raw_status, 'nan')) - 1 AS DOUBLE) AS raw_status"
    return _FM + _cleaned_sql("feature_matrix", _FM_NUM, mode, code) + " UNION ALL ".join(
        f"SELECT mail_id, label, '{c}' AS feature, round({c}, 6) AS value FROM fin WHERE (SELECT min({c}) < max({c}) FROM fin)"
        for c in [*_FM_NUM, "raw_status"])


def _clean_rows(mode: str):
    def build(spark, sf):
        t, _ = C.clean_and_encode(fx.feature_matrix(spark, sf), "B", mode)
        features = [c for c in t.columns if c not in ("mail_id", "label")]
        return M.rounded(t.select("mail_id", "label", *[F.col(c).cast("double").alias(c) for c in features])
                         .unpivot(["mail_id", "label"], features, "feature", "value"))
    return build


for _mode in ("reference", "counts"):
    register(f"clean_and_encode_{_mode}", _clean_rows_sql(_mode))(_clean_rows(_mode))


@register("clean_wide", O.mail_prefix() + ", w AS MATERIALIZED (SELECT mail_id, label, "
          + ", ".join(f"{O.FEATURE_SQL[c]} AS {c}" for c in W.WIDE_FEATURES) + " FROM hd)"
          + _cleaned_sql("w", W.WIDE_FEATURES, "reference") + " UNION ALL ".join(
              f"SELECT '{c}' AS feature, count(*) AS n, round(round(avg({c}), 12), 6) AS mean, round(max({c}), 6) AS largest "
              f"FROM fin HAVING min({c}) < max({c})" for c in W.WIDE_FEATURES))
def q_clean_wide(spark, sf):
    """The cleaning of all 81 extracted columns, one row per column that is left."""
    # extracted once: the cleaning reads its input for medians, caps, constants and rows
    wide = W.wide_features(fx.raw_mail(spark, sf)).checkpoint()
    t, _ = C.clean_and_encode(wide, "A", "reference")
    features = [c for c in t.columns if c not in ("mail_id", "label")]
    row = t.agg(*[F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.col(c).cast("double")).alias("mean"),
                           F.max(F.col(c).cast("double")).alias("largest")).alias(c) for c in features])
    out = row.unpivot([], features, "feature", "s").select("feature", "s.n", "s.mean", "s.largest")
    return M.rounded(out, settle=12)


def _group(group: str):
    def build(spark, sf):
        wanted = GR.group_columns(group, W.WIDE_FEATURES)
        return GR.feature_subset(W.wide_features(fx.raw_mail(spark, sf), columns=wanted), group)
    return build


for _g in ("G1", "G2", "G3", "G4", "G5", "G6", "G7", "G8"):
    register(f"feature_subset_{_g.lower()}", O.wide_sql(GR.group_columns(_g, W.WIDE_FEATURES)))(_group(_g))


@register("overall_corr", _group_corr_sql("within").replace("SELECT sz.feature_group", ", wc AS (SELECT sz.feature_group").replace(
    "round(CASE WHEN n_features >= 2 THEN w END, 6)", "CASE WHEN n_features >= 2 THEN w END") + """),
bt AS (SELECT avg(abs(sp.s)) AS between_corr FROM pos a JOIN pos b
       ON a.pos < b.pos AND a.first_group <> b.first_group LEFT JOIN sp ON sp.f1 = a.feature AND sp.f2 = b.feature)
SELECT round(avg(within_corr), 6) AS mean_within, round(max(between_corr), 6) AS between_corr,
       round(avg(within_corr) / max(between_corr), 6) AS ratio FROM wc, bt""")
def q_overall_corr(spark, sf):
    pairs, positions = _pairs_and_positions(spark, sf)
    return M.rounded(J.overall_corr(J.within_group_corr(pairs, positions), J.between_group_corr(pairs, positions)))


# the supplied tables hold no timings: a cell's mean of `mail_id % 97` stands for its scoring time
_TIMED_SQL = _RES_SQL.rstrip() + """,
tm AS (SELECT dataset, feature_group, model_name, avg(CAST(mail_id % 97 AS DOUBLE)) AS inference_ms_per_1k
       FROM scored GROUP BY dataset, feature_group, model_name),
rt AS (SELECT * FROM res JOIN tm USING (dataset, feature_group, model_name))
"""


def _timed_results(spark, sf):
    cell = ["dataset", "feature_group", "model_name"]
    times = fx.scored(spark, sf).groupBy(*cell).agg(F.avg((F.col("mail_id") % 97).cast("double")).alias("inference_ms_per_1k"))
    return _results(spark, sf).join(times, cell)


@register("fastest_within_1pct", _TIMED_SQL + """
SELECT dataset, model_name, feature_group, round(inference_ms_per_1k, 6) AS inference_ms_per_1k,
       round(accuracy, 6) AS accuracy, round(best_accuracy, 6) AS best_accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY inference_ms_per_1k, pos) AS rn
      FROM (SELECT *, max(accuracy) OVER (PARTITION BY dataset) AS best_accuracy FROM rt) t
      WHERE accuracy >= best_accuracy - 0.01) u WHERE rn = 1""")
def q_fastest_within(spark, sf):
    return M.rounded(R.fastest_within(_timed_results(spark, sf)))


@register("accuracy_time", _TIMED_SQL + """
SELECT dataset, model_name, feature_group, round(inference_ms_per_1k, 6) AS inference_ms_per_1k,
       round(accuracy, 6) AS accuracy FROM rt""")
def q_accuracy_time(spark, sf):
    return M.rounded(R.accuracy_vs_time(_timed_results(spark, sf)))


@register("timing_stats", _TIMED_SQL + """
SELECT model_name, round(avg(inference_ms_per_1k), 6) AS mean, round(stddev_pop(inference_ms_per_1k), 6) AS std,
       round(min(inference_ms_per_1k), 6) AS min, round(max(inference_ms_per_1k), 6) AS max FROM tm GROUP BY model_name""")
def q_timing_stats(spark, sf):
    return M.rounded(M.timing_stats(_timed_results(spark, sf), "inference_ms_per_1k", ["model_name"]))


@register("best_baseline", _RES_SQL + """
SELECT dataset, round(max(accuracy), 6) AS best_accuracy FROM res WHERE feature_group = 'G1' GROUP BY dataset""")
def q_best_baseline(spark, sf):
    return M.rounded(R.best_baseline_accuracy(_results(spark, sf).where("feature_group = 'G1'")))


@register("metric_listing", _RES_SQL + "SELECT model_name, feature_group, " + ", ".join(
    f"round(round({m}, 12), 4) AS {m}" for m in _RES_METRICS) + " FROM res")
def q_metric_listing(spark, sf):
    return R.metric_listing(_results(spark, sf))


@register("datasets", _SC + "SELECT DISTINCT dataset FROM scored")
def q_datasets(spark, sf):
    return R.datasets(_results(spark, sf))
