"""Queries over the solvers, the pivot index, the keyed shuffle, the experiment
ledger and mail folders.  What a fitted model gives is held as properties
that must hold (stopping, shares, bounds); rows, labels and shuffles exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailspark import oracle as O
from mailspark.catalog import register
from mailspark.functions import headers as H
from mailspark.operators import clean as C
from mailspark.operators import compact as CP
from mailspark.operators import folds as FO
from mailspark.operators import groups as GR
from mailspark.operators import importance as IM
from mailspark.operators import metrics as M
from mailspark.operators import models as MD
from mailspark.operators import one_class
from mailspark.operators import permute
from mailspark.operators import score as SC
from mailspark.operators import wide as W
from mailspark.plans import queries as Q
from mailspark.plans.experiment import run_matrix
from mailspark.session import scratch_dir
from mailspark.sources import fixtures as fx
from mailspark.sources import mail as ML

_HELD = """
, held AS (SELECT mail_id, label, CAST(rn <= ceil(n * {share}) AS INTEGER) AS is_test FROM (
    SELECT mail_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(mail_id AS VARCHAR) || '42'), mail_id) AS rn,
           count(*) OVER (PARTITION BY label) AS n FROM {source}) t)
"""


def _wide_sql(cols: list[str]) -> str:
    return O.mail_prefix() + ", w AS MATERIALIZED (SELECT mail_id, label, " + ", ".join(
        f"CAST({O.FEATURE_SQL[c]} AS DOUBLE) AS {c}" for c in cols) + " FROM hd)"


# --------------------------------------------------------------------------
# G11m, G12m: the one-class solver
# --------------------------------------------------------------------------
_G6 = GR.group_columns("G6", W.WIDE_FEATURES)


@register("one_class_solver", Q._FM + _HELD.format(share=0.2, source="feature_matrix") + """
SELECT count(*) AS n_ham, true AS outlier_share_is_nu, true AS objective_falls, true AS gap_closed
FROM held WHERE is_test = 0 AND label = 0""")
def q_one_class_solver(spark, sf):
    """The share of training rows outside the boundary is nu within 0.01, the solver's objective
    falls below the mean embedding's (round 0) and its duality gap closes."""
    s = FO.holdout_split(Q._imputed_fm(spark, sf), 0.2, 42)
    train, _ = MD.scaled(FO.ham_only(s.where("is_test = 0")), s, Q._MODEL_COLS)
    train = train.select(*Q._MODEL_COLS).checkpoint()
    nu, fourier = MD.DEFAULTS["OC_SVM"]["nu"], MD._fourier(len(Q._MODEL_COLS), 256, 1.0 / len(Q._MODEL_COLS))
    w, history = one_class.solve(train, Q._MODEL_COLS, nu, fourier)
    scored = train.withColumn("_s", MD._matrix_udf(lambda x: fourier(x) @ w, Q._MODEL_COLS, "double")).checkpoint()
    rho = one_class.offset(scored, nu)
    outside = F.avg((F.col("_s") < F.lit(rho)).cast("double"))
    return scored.agg(F.count("*").alias("n_ham"), (F.abs(outside - nu) <= 0.01).alias("outlier_share_is_nu")).select(
        "*", F.lit(history[-1][1] < history[0][1]).alias("objective_falls"),
        F.lit(history[-1][2] <= 2 * one_class.GAP * 2 * history[-1][1]).alias("gap_closed"))


# --------------------------------------------------------------------------
# G9m: early stopping
# --------------------------------------------------------------------------
@register("mlp_early_stopping", Q._FM + _HELD.format(share=0.2, source="feature_matrix") + """
, inner_split AS (SELECT label, CAST(ceil(count(*) * 0.1) AS BIGINT) AS n FROM held WHERE is_test = 0 GROUP BY label)
SELECT CAST((SELECT sum(n) FROM inner_split) AS BIGINT) AS n_validation, CAST(count(*) AS BIGINT) AS n_train,
       true AS stopped_early, true AS kept_is_best, true AS one_kept FROM held WHERE is_test = 0""")
def q_mlp_early_stopping(spark, sf):
    """Training ends before the last step, and the kept round has the best held-out accuracy of the history."""
    s = FO.holdout_split(Q._imputed_fm(spark, sf), 0.2, 42)
    train, _ = MD.scaled(s.where("is_test = 0").drop("is_test"), s, Q._MODEL_COLS)
    rows = MD._vec(train, Q._MODEL_COLS).select("mail_id", "label", "features").checkpoint()
    p = MD.DEFAULTS["MLP"]
    _, history = MD.fit_mlp(rows, [len(Q._MODEL_COLS), *p["hidden"], 2], p, 42)
    held = FO.holdout_split(rows.select("mail_id", "label"), p["validation"], 42)
    rounds = spark.createDataFrame(history, "round int, steps int, accuracy double, kept boolean")
    seen = rounds.agg((F.max("steps") < p["maxIter"]).alias("stopped_early"),
                      (F.max(F.when(F.col("kept"), F.col("accuracy"))) == F.max("accuracy")).alias("kept_is_best"),
                      (F.sum(F.col("kept").cast("int")) == 1).alias("one_kept"))
    return held.agg(F.sum("is_test").cast("bigint").alias("n_validation"), F.count("*").alias("n_train")).crossJoin(F.broadcast(seen))


# --------------------------------------------------------------------------
# G10m at the width of a real group
# --------------------------------------------------------------------------
def _knn_group_sql(cols: list[str], k: int = 5) -> str:
    """Every distance between distinct test and training points, with counts."""
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    sc = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}" for c in cols)
    names, dist = ", ".join(cols), " + ".join(f"pow(q.{c} - t.{c}, 2)" for c in cols)
    take = f"least(n, greatest({k} - (cum - n), 0))"
    return _wide_sql(cols) + _HELD.format(share=0.2, source="w") + f"""
, st AS (SELECT {st} FROM w JOIN held USING (mail_id) WHERE is_test = 0),
x AS MATERIALIZED (SELECT mail_id, w.label, is_test, {sc} FROM w JOIN held USING (mail_id), st),
t AS MATERIALIZED (SELECT {names}, count(*) AS n, sum(label) AS pos FROM x WHERE is_test = 0 GROUP BY {names}),
q AS MATERIALIZED (SELECT {names}, min(mail_id) AS qid FROM x WHERE is_test = 1 GROUP BY {names}),
dd AS (SELECT qid, round(sqrt({dist}), 9) AS d, sum(n) AS n, sum(pos) AS pos FROM q, t GROUP BY qid, d),
c AS (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM dd),
p AS (SELECT qid, round(sum({take} * pos / n) / sum({take}), 6) AS y_prob FROM c GROUP BY qid)
SELECT mail_id, y_prob FROM x JOIN q USING ({names}) JOIN p USING (qid) WHERE is_test = 1"""


@register("knn_predict_g6", _knn_group_sql(_G6))
def q_knn_predict_g6(spark, sf):
    wide = W.wide_features(fx.raw_mail(spark, sf), columns=_G6).checkpoint()
    s = FO.holdout_split(wide, 0.2, 42).checkpoint()
    out = MD.knn_predict(s.where("is_test = 0"), s.where("is_test = 1"), _G6, k=5)
    return M.rounded(out.select("mail_id", "y_prob"))


# --------------------------------------------------------------------------
# The keyed shuffle, and importance of a rule that SQL can apply
# --------------------------------------------------------------------------
_SHUFFLED, _REPEATS = ["subject_len", "n_received_hops", "spf_result", "has_reply_to"], 3


def _permuted_sql() -> str:
    src = ", ".join(_SHUFFLED)
    joins = " ".join(f"JOIN num x{r} ON num.i = {permute.shuffled_sql(f'x{r}.i', f'x{r}.n', permute.keys(42, r))}"
                     for r in range(_REPEATS))
    return Q._imputed_fm_sql() + f"""
, num AS MATERIALIZED (SELECT mail_id, label, {src}, row_number() OVER (ORDER BY mail_id) - 1 AS i,
  count(*) OVER () AS n FROM imp)
, perm AS MATERIALIZED (SELECT num.mail_id, num.label, {", ".join(f"num.{c}" for c in _SHUFFLED)}, """ + ", ".join(
        f"x{r}.{c} AS {c}_{r}" for r in range(_REPEATS) for c in _SHUFFLED) + f" FROM num {joins})"


@register("permuted_rows", _permuted_sql() + "SELECT mail_id, " + ", ".join(
    f"round({c}_{r}, 6) AS {c}_{r}" for r in range(_REPEATS) for c in _SHUFFLED) + " FROM perm")
def q_permuted_rows(spark, sf):
    rows = IM.permuted_rows(Q._imputed_fm(spark, sf), _SHUFFLED, _REPEATS)
    return M.rounded(rows.select("mail_id", *[F.col(f"_x{r}")[i].alias(f"{c}_{r}") for r in range(_REPEATS)
                                              for i, c in enumerate(_SHUFFLED)]))


_RULE = "CASE WHEN {spf_result} < 0 OR {n_received_hops} > 8 OR {subject_len} > 250000 THEN 1 ELSE 0 END"


def _rule_sql() -> str:
    base = "avg(CAST(" + _RULE.format(**{c: c for c in _SHUFFLED}) + " = label AS INTEGER))"
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {base} - avg(CAST(" + _RULE.format(**{o: f"{o}_{r}" if o == c else o for o in _SHUFFLED})
        + " = label AS INTEGER)) AS fall FROM perm" for c in _SHUFFLED for r in range(_REPEATS))
    return _permuted_sql() + f"""SELECT feature, round(round(avg(fall), 12), 6) AS importance_mean,
       round(round(stddev_pop(fall), 12), 6) AS importance_std FROM ({rows}) GROUP BY feature"""


@register("permutation_rule", _rule_sql())
def q_permutation_rule(spark, sf):
    """Importance of a fixed rule's features: the same job as for a fitted model, exact in SQL."""
    def rule(df):
        return df.withColumn("prediction", F.expr(_RULE.format(**{c: c for c in _SHUFFLED})).cast("double"))
    return M.rounded(IM.permutation_importance(rule, Q._imputed_fm(spark, sf), _SHUFFLED, _REPEATS), settle=12)


# --------------------------------------------------------------------------
# G17m: the matrix with its ledger, stopped and taken up again
# --------------------------------------------------------------------------
_MATRIX_GROUPS, _MATRIX_MODELS = ("G5", "G8"), ("KNN", "RF")


@register("matrix_cells", O.prefix_for("raw_mail") + """
SELECT 'A' AS dataset, g.feature_group, g.n_features, m.model_name, count(*) AS n, count(DISTINCT mail_id) AS n_mails,
       CAST(sum(label) AS BIGINT) AS n_positive, 5 AS n_folds, true AS in_range
FROM raw_mail, (VALUES """ + ", ".join(f"('{g}', {len(GR.group_columns(g, W.WIDE_FEATURES))})" for g in _MATRIX_GROUPS)
          + ") g(feature_group, n_features), (VALUES " + ", ".join(f"('{m}')" for m in _MATRIX_MODELS) + """) m(model_name)
GROUP BY ALL""")
def q_matrix_cells(spark, sf):
    """One row per cell.  The first run does half of the cells; the second one reads them from the ledger."""
    cols = list(dict.fromkeys(c for g in _MATRIX_GROUPS for c in GR.group_columns(g, W.WIDE_FEATURES)))
    table, ledger = W.wide_features(fx.raw_mail(spark, sf), columns=cols).checkpoint(), scratch_dir(spark, "matrix")
    run = {"models": _MATRIX_MODELS, "ledger": ledger, "parallel_cells": 4, "params": {"RF": {"numTrees": 20}}}
    run_matrix(spark, {"A": table}, groups=_MATRIX_GROUPS[:1], **run)
    out = run_matrix(spark, {"A": table}, groups=_MATRIX_GROUPS, **run)
    return out["predictions"].groupBy("dataset", "feature_group", "n_features", "model_name").agg(
        F.count("*").alias("n"), F.countDistinct("mail_id").alias("n_mails"), F.sum("y_true").cast("bigint").alias("n_positive"),
        F.countDistinct("fold").cast("int").alias("n_folds"), F.every(F.col("y_prob").between(0, 1)).alias("in_range"))


# --------------------------------------------------------------------------
# G13m, G15m: stacking over outer folds
# --------------------------------------------------------------------------
_STACK_GROUP = GR.group_columns("G8", W.WIDE_FEATURES)
#: small base models: every outer fold fits each of them inner_folds + 1 times
_STACK = {"inner_folds": 3, "base_params": {"RF": {"numTrees": 20, "maxDepth": 10}, "MLP": {"hidden": [16], "maxIter": 60}}}


@register("stacking_cv", O.prefix_for("raw_mail") + f"""
SELECT fold, count(*) AS n, count(DISTINCT mail_id) AS n_mails, CAST(sum(label) AS BIGINT) AS n_positive,
       true AS in_range, true AS consistent, true AS as_good_as_larger_class
FROM (SELECT mail_id, label, {Q._FOLD_SQL} AS fold FROM raw_mail) f GROUP BY fold""")
def q_stacking_cv(spark, sf):
    """Each mail is scored once, by the stack that was fitted on the other folds."""
    wide = W.wide_features(fx.raw_mail(spark, sf), columns=_STACK_GROUP)
    folded = FO.stratified_folds(wide, 5, 42).checkpoint()
    pred = MD.cv_predictions(folded, _STACK_GROUP, "Stacking", "A", "G8", 5, _STACK)
    positive, right = F.avg("y_true"), F.avg((F.col("y_pred") == F.col("y_true")).cast("double"))
    return pred.groupBy("fold").agg(
        F.count("*").alias("n"), F.countDistinct("mail_id").alias("n_mails"), F.sum("y_true").cast("bigint").alias("n_positive"),
        F.every(F.col("y_prob").between(0, 1)).alias("in_range"),
        F.every(F.col("y_pred") == (F.col("y_prob") > 0.5).cast("int")).alias("consistent"),
        (right >= F.greatest(positive, 1 - positive) - 0.01).alias("as_good_as_larger_class"))


# --------------------------------------------------------------------------
# Folders of single mails, written by the query
# --------------------------------------------------------------------------
_SUPPLIER_MAIL = """
select s_suppkey as k, case s_suppkey % 3 when 0 then 'spam' when 1 then 'ham' else 'phishing' end as class,
       case when s_suppkey % 10 = 9 then '' else 'From: u' || cast(s_suppkey as string) || '@corp.example' || chr(10)
         || 'Subject: ' || s_name || chr(10) || chr(10) || 'body of ' || s_name end as raw
from {supplier}"""


@register("folder_scan", "WITH m AS (" + _SUPPLIER_MAIL.format(supplier="supplier") + """)
SELECT layout, k, CASE WHEN layout = 'flat' THEN 'ham' ELSE class END AS class,
       CAST(CASE WHEN layout = 'flat' OR class = 'ham' THEN 0 ELSE 1 END AS INTEGER) AS label,
       CAST(CASE WHEN raw = '' THEN 0 ELSE 1 END AS INTEGER) AS has_from,
       CAST(CASE WHEN raw = '' THEN 0 ELSE length(split_part(split_part(raw, 'Subject: ', 2), chr(10), 1)) END AS INTEGER) AS subject_len,
       (SELECT count(*) FROM m b WHERE layout = 'flat' OR b.class = m.class) AS n_files
FROM m, (VALUES ('classes'), ('flat')) l(layout)""")
def q_folder_scan(spark, sf):
    """A file per mail: once below class folders, once flat under a folder that is itself named spam.
    Every tenth file is empty."""
    mails = spark.sql(_SUPPLIER_MAIL, supplier=fx.table(spark, sf, "supplier")).withColumn("n", F.col("k"))
    root = scratch_dir(spark, "folders")
    parts = []
    for layout in ("classes", "flat"):
        at = f"{root}/{layout}" if layout == "classes" else f"{root}/spam/flat"
        for name in ML.CLASS_LABELS:
            # a fixed number of tasks: by their few bytes the planner would write all files in one
            rows = mails.where(F.col("class") == name).select("raw", "n").repartition(
                int(spark.conf.get("spark.sql.shuffle.partitions")), "n")
            to = f"{at}/{name}" if layout == "classes" else at
            rows.write.mode("append").partitionBy("n").option("lineSep", "\n").option(
                "mapreduce.fileoutputcommitter.algorithm.version", 2).text(to)  # tasks move their own files
        read = ML.read_mail_dir(spark, at, glob="part-*")
        cls = ML.class_of_path(ML.below(spark, at, F.col("path")))
        counts = ML.corpus_counts(spark, at).withColumnRenamed("class", "c")
        feats = CP.compact_features(read.withColumn("class", cls).withColumn(
            "k", F.regexp_extract("path", r"/n=(\d+)/", 1).cast("bigint")), keep=("k", "class", "label"))
        parts.append(feats.join(F.broadcast(counts), F.col("class") == F.col("c")).select(
            F.lit(layout).alias("layout"), "k", "class", "label", "has_from", "subject_len", F.col("n_files")))
    return parts[0].unionByName(parts[1])


@register("class_cap_rows", O.prefix_for("raw_mail") + f"""
SELECT mail_id, label, path, CAST(length(raw) AS INTEGER) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY path) AS rn FROM raw_mail) t WHERE rn <= {Q.CLASS_CAP}""")
def q_class_cap_rows(spark, sf):
    capped = ML.cap_per_class(fx.raw_mail(spark, sf), Q.CLASS_CAP)
    return capped.select("mail_id", "label", "path", F.length("raw").cast("int").alias("n_chars"))


# --------------------------------------------------------------------------
# B1 on mails with CRLF and long bodies
# --------------------------------------------------------------------------
@register("header_split_crlf", O.header_split_sql())
def q_header_split_crlf(spark, sf):
    """CRLF line ends and bodies of several kB that hold header-like lines: the same headers."""
    rm = fx.raw_mail(spark, sf).withColumn("raw", F.concat(
        F.replace(F.col("raw"), F.lit("\n"), F.lit("\r\n")), F.repeat(F.lit("\r\nX-Body: no header\r\n\r\nmore"), 200)))
    h = rm.select("mail_id", F.explode(H.split_headers(F.col("raw"))).alias("h"))
    return h.select("mail_id", F.col("h.pos").cast("int").alias("pos"), F.col("h.name_lc").alias("name_lc"),
                    F.length("h.value").cast("int").alias("value_len"), F.col("h.value").alias("value"))


# --------------------------------------------------------------------------
# groups as tables, with the means of their features
# --------------------------------------------------------------------------
def _groups_sql(groups: dict[str, list[str]], cols: list[str]) -> str:
    rows = ", ".join(f"('{g}', {i}, '{c}')" for g, own in groups.items() for i, c in enumerate(own, 1))
    means = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(round(avg({c}), 12), 6) AS mean FROM w" for c in cols)
    return _wide_sql(cols) + f"""
SELECT feature_group, pos, feature, mean FROM (VALUES {rows}) g(feature_group, pos, feature) JOIN ({means}) m USING (feature)"""


def _group_means(spark, sf, table, cols):
    wide = W.wide_features(fx.raw_mail(spark, sf), columns=cols)
    row = wide.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    return M.rounded(table.join(F.broadcast(row.unpivot([], cols, "feature", "mean")), "feature"), settle=12)


_ALL_GROUPS = {g: GR.group_columns(g, W.WIDE_FEATURES) for g in GR.GROUP_NAMES}
_GROUPED = list(dict.fromkeys(c for own in _ALL_GROUPS.values() for c in own))
_ALTERNATIVE = GR.alternative_groups(W.WIDE_FEATURES)
_ALTERNATIVE_COLS = list(dict.fromkeys(c for own in _ALTERNATIVE.values() for c in own))


@register("feature_groups", _groups_sql(_ALL_GROUPS, _GROUPED))
def q_feature_groups(spark, sf):
    return _group_means(spark, sf, GR.feature_groups_table(spark, W.WIDE_FEATURES), _GROUPED)


@register("alternative_groups", _groups_sql(_ALTERNATIVE, _ALTERNATIVE_COLS))
def q_alternative_groups(spark, sf):
    return _group_means(spark, sf, GR.groups_table(spark, GR.alternative_groups(W.WIDE_FEATURES)), _ALTERNATIVE_COLS)


@register("missing_present", Q._RM + "SELECT status, count(*) AS n_features, (SELECT count(*) FROM raw_mail) AS n_mails FROM (VALUES "
          + ", ".join(f"('{'present' if c in W.WIDE_FEATURES else 'missing'}')" for c in GR.ALTERNATIVE_G6) + ") t(status) GROUP BY status")
def q_missing_present(spark, sf):
    """Which of the second map's G6 the extractor has."""
    wide = W.wide_features(fx.raw_mail(spark, sf))
    missing, present = GR.missing_present(wide, GR.ALTERNATIVE_G6)
    n = spark.createDataFrame([("missing", len(missing)), ("present", len(present))], "status string, n_features bigint")
    return n.crossJoin(F.broadcast(wide.agg(F.count("*").alias("n_mails"))))


# --------------------------------------------------------------------------
# All fields that do not depend on the fit
# --------------------------------------------------------------------------
_FIELDS = CP.COMPACT_FEATURES


@register("score_dual_fields", f"""
SELECT CAST(mail_id AS VARCHAR) AS email_id, message_id, 'in-memory' AS source_path, '{SC.FEATURE_VERSION}' AS feature_version,
       {len(_FIELDS)} AS feature_count, '{",".join(_FIELDS)}' AS used_features, true AS sums_to_one, true AS consistent
FROM ({Q._COMPACT_SQL}) q""")
def q_score_dual_fields(spark, sf):
    s = SC.score_v2(*Q._served(spark, sf), source_path="in-memory")
    mal, leg = F.col("malicious_probability"), F.col("legitimate_probability")
    return s.select("email_id", "message_id", "source_path", "feature_version", "feature_count",
                    F.array_join("used_features", ",").alias("used_features"), (F.abs(mal + leg - 1) <= 1.1e-4).alias("sums_to_one"),
                    ((F.col("confidence") == F.greatest(mal, leg)) & (F.col("prediction") == "malicious").eqNullSafe(mal >= leg)).alias("consistent"))


@register("detection_counts", O.prefix_for("raw_mail") + """
SELECT count(*) AS total, true AS adds_up, true AS rate_ok FROM raw_mail""")
def q_detection_counts(spark, sf):
    d = SC.detection_rate(SC.score_v1(*Q._served(spark, sf)))
    return d.select("total", (F.col("malicious") + F.col("legitimate") == F.col("total")).alias("adds_up"),
                    (F.col("detection_rate") == F.round(F.col("malicious") * 100.0 / F.col("total"), 1)).alias("rate_ok"))


# --------------------------------------------------------------------------
# Running counts that survive a restart
# --------------------------------------------------------------------------
def _rule_label():
    hf = F.col("header_features")
    bad = (F.coalesce(hf["spf_result"].try_cast("int"), F.lit(0)) < 0) | (F.coalesce(hf["mid_malformed"].try_cast("int"), F.lit(0)) > 0)
    return F.when(bad, "malicious").otherwise("legitimate")


@register("running_counts", f"""
SELECT CASE WHEN spf_result < 0 OR mid_malformed > 0 THEN 'malicious' ELSE 'legitimate' END AS prediction, count(*) AS n
FROM ({Q._COMPACT_SQL}) q GROUP BY 1""")
def q_running_counts(spark, sf):
    """Requests arrive in two deliveries, the second one late and with a repeat of part of the first; the
    stream is stopped between them and goes on from its checkpoint."""
    from mailspark.streaming.score_stream import latest_counts, start_running_counts
    in_dir, out_dir, ck = (scratch_dir(spark, x) for x in ("arrivals", "counts", "counts-ck"))
    requests = Q._requests(spark, sf).withColumn("_part", F.pmod(F.xxhash64("email_id"), F.lit(3))).checkpoint()
    for delivery in ("_part < 2", "_part > 0"):
        requests.where(delivery).drop("_part").write.mode("append").json(in_dir)
        start_running_counts(spark, lambda df: df.withColumn("prediction", _rule_label()), in_dir, out_dir, ck, multiline=False).awaitTermination()
    return latest_counts(spark, out_dir)
