"""Queries over operators that need their own inputs: decoding and coercion of
derived header values, whole-width correlation, export round trips, and
checks of fitted models (row counts and labels exact, quality as bounds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailspark import oracle as O
from mailspark import sinks as SK
from mailspark.catalog import _ORACLE as REGISTERED
from mailspark.catalog import register
from mailspark.functions import dates as D
from mailspark.functions import headers as H
from mailspark.operators import clean as C
from mailspark.operators import compact as CP
from mailspark.operators import correlate as J
from mailspark.operators import folds as FO
from mailspark.operators import groups as GR
from mailspark.operators import importance as IM
from mailspark.operators import metrics as M
from mailspark.operators import models as MD
from mailspark.operators import score as SC
from mailspark.operators import wide as W
from mailspark.plans import queries as Q
from mailspark.session import scratch_dir
from mailspark.sources import documents as DOC
from mailspark.sources import fixtures as fx


def _orders(spark, sf, sql):
    return spark.sql(sql, orders=fx.table(spark, sf, "orders"))


# --------------------------------------------------------------------------
# B5, B10, B25-B28 over values derived from ``orders``
# --------------------------------------------------------------------------
def _encoded_sql(b64: str) -> str:
    word = f"'=?utf-8?B?' || {b64} || '?='"
    return f"""
select o_orderkey as mail_id, case o_orderkey % 6
  when 0 then {word} when 1 then '  plain ' || o_orderpriority || chr(10) || ' folded '
  when 2 then '=?iso-8859-1?Q?caf=E9_' || cast(o_orderkey as string) || '?=' when 3 then 'Re: ' || {word} || ' end'
  when 4 then '=?utf-8?X?bad?=' end as v
from {{orders}}"""


@register("mime_decode", """
SELECT o_orderkey AS mail_id, CASE o_orderkey % 6
  WHEN 0 THEN 'Grüße ' || o_orderpriority WHEN 1 THEN 'plain ' || o_orderpriority || ' folded'
  WHEN 2 THEN 'café ' || CAST(o_orderkey AS VARCHAR) WHEN 3 THEN 'Re: Grüße ' || o_orderpriority || ' end'
  WHEN 4 THEN '=?utf-8?X?bad?=' ELSE '' END AS decoded FROM orders""")
def q_mime_decode(spark, sf):
    v = _orders(spark, sf, _encoded_sql("base64(encode('Grüße ' || o_orderpriority, 'utf-8'))"))
    return v.select("mail_id", H.decode_mime(F.col("v")).alias("decoded"))


@register("unicode_categories", O.prefix_for("raw_mail") + r"""
SELECT mail_id, CAST(len(regexp_extract_all(raw, '\p{P}')) AS INTEGER) AS punctuation,
       CAST(len(regexp_extract_all(raw, '\p{Lu}')) AS INTEGER) AS upper_case,
       CAST(len(regexp_extract_all(raw, '\p{Cc}')) AS INTEGER) AS control FROM raw_mail""")
def q_unicode_categories(spark, sf):
    rm = fx.raw_mail(spark, sf)
    return rm.select("mail_id", *[H.count_unicode_category(F.col("raw"), c).cast("int").alias(n) for c, n in (
        ("P", "punctuation"), ("Lu", "upper_case"), ("Cc", "control"))])


_SPELLINGS_SQL = """
select o_orderkey as mail_id, case o_orderkey % 6
  when 0 then 'Mon, ' || dm || ' ' || yy || ' 10:20:30 +0530' when 1 then dm || ' ' || yy || ' 23:59:59 -0100 (comment)'
  when 2 then dm || ' ' || substr(yy, 3, 2) || ' 08:00 GMT' when 3 then dm || ' ' || yy || ' 10:20:30 EST'
  when 4 then dm || ' ' || yy || ' 10:20:30' else replace(dm, ' ', '-') || '-' || yy || ' 01:02:03 +0000' end as v
from (select *, lpad(cast(day(o_orderdate) as string), 2, '0') || ' '
             || substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) * 3 - 2 as int), 3) as dm,
             cast(year(o_orderdate) as string) as yy from {orders}) t"""


@register("date_to_utc", """
SELECT o_orderkey AS mail_id, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + CASE o_orderkey % 6
  WHEN 0 THEN INTERVAL 17430 SECOND WHEN 1 THEN INTERVAL 89999 SECOND WHEN 2 THEN INTERVAL 28800 SECOND
  WHEN 3 THEN INTERVAL 55230 SECOND WHEN 4 THEN INTERVAL 37230 SECOND ELSE INTERVAL 3723 SECOND END,
  '%Y-%m-%dT%H:%M:%S+00:00') AS utc FROM orders""")
def q_date_to_utc(spark, sf):
    return _orders(spark, sf, _SPELLINGS_SQL).select("mail_id", D.date_to_utc_iso(F.col("v")).alias("utc"))


@register("request_coercion", """
SELECT o_orderkey AS mail_id, CAST(CASE o_orderkey % 11 WHEN 0 THEN o_custkey WHEN 1 THEN 3.5 WHEN 4 THEN 1 WHEN 6 THEN -125
         WHEN 9 THEN 0.5 ELSE 0 END AS DOUBLE) AS value,
       round(round(1 / (1 + exp(-(o_custkey - 500) / 50.0)), 12), 6) AS probability,
       CASE WHEN o_orderkey % 2 = 1 THEN 'malicious' ELSE 'legitimate' END AS label FROM orders""")
def q_request_coercion(spark, sf):
    v = _orders(spark, sf, """
select o_orderkey as mail_id, o_custkey, case o_orderkey % 11 when 0 then cast(o_custkey as string) when 1 then ' 3.5 '
  when 2 then 'nan' when 3 then '1d' when 4 then 'true' when 5 then 'abc' when 6 then '-1.25e2' when 7 then 'False'
  when 8 then '1f' when 9 then '.5' end as v from {orders}""")
    return M.rounded(v.select("mail_id", H.to_number(F.col("v")).alias("value"),
                              H.sigmoid((F.col("o_custkey") - 500) / F.lit(50.0)).alias("probability"),
                              H.class_to_label(F.col("mail_id") % 2).alias("label")), settle=12)


# --------------------------------------------------------------------------
# D5 folder job, L2 fields that do not depend on the fit
# --------------------------------------------------------------------------
@register("folder_documents", O.prefix_for("raw_mail") + f"""
SELECT 'email_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS email_id,
       q.* EXCLUDE (mail_id, label)
FROM (SELECT mail_id, row_number() OVER (ORDER BY path) AS n FROM raw_mail
      WHERE regexp_matches(lower(regexp_replace(split_part(raw, chr(10), 1), '^\\s+|\\s+$', '', 'g')),
                           '^({"|".join(CP.MAIL_PREFIXES)})')) r
JOIN ({Q._COMPACT_SQL}) q USING (mail_id)""")
def q_folder_documents(spark, sf):
    docs = CP.extract_folder(fx.raw_mail(spark, sf), start_index=1)
    return docs.select("email_id", "header_features.*", "headers.date", "headers.message_id")


@register("score_fields", f"""
SELECT CAST(mail_id AS VARCHAR) AS email_id, nullif(message_id, '') AS message_id,
       strftime(timezone('UTC', try_strptime(date, '%d %b %Y %H:%M:%S %z')), '%Y-%m-%dT%H:%M:%S+00:00') AS dated,
       true AS label_ok, true AS confidence_ok FROM ({Q._COMPACT_SQL}) q""")
def q_score_fields(spark, sf):
    """L2 without its scores; a mail without a readable date carries the time of scoring (null here)."""
    requests, model = Q._served(spark, sf)
    readable = requests.select("email_id", D.parse_mail_date(SC.header_value(F.col("headers"), "date")).isNotNull().alias("readable"))
    s = SC.score_v1(requests, model).join(readable, "email_id")
    return s.select("email_id", "message_id", F.when(F.col("readable"), F.col("timestamp")).alias("dated"),
                    F.col("prediction").isin("malicious", "legitimate").alias("label_ok"),
                    F.col("confidence").between(0.5, 1).alias("confidence_ok"))


# --------------------------------------------------------------------------
# 2.J at the width of the extractor
# --------------------------------------------------------------------------
def _wide_spearman_sql() -> str:
    cols = ", ".join(f"CAST({O.FEATURE_SQL[c]} AS DOUBLE) AS {c}" for c in W.WIDE_FEATURES)
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(W.WIDE_FEATURES))
    return O.mail_prefix() + f""", w AS MATERIALIZED (SELECT mail_id, {cols} FROM hd),
o AS (SELECT * FROM (VALUES {order}) t(feature, idx)),
rk AS MATERIALIZED (SELECT mail_id, feature, idx, rank() OVER (PARTITION BY feature ORDER BY value)
       + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r
       FROM (UNPIVOT w ON {", ".join(W.WIDE_FEATURES)} INTO NAME feature VALUE value) u JOIN o USING (feature)),
c AS MATERIALIZED (SELECT a.feature AS f1, b.feature AS f2, corr(a.r, b.r) AS s FROM rk a JOIN rk b ON a.mail_id = b.mail_id AND a.idx < b.idx
      GROUP BY a.feature, b.feature)
SELECT f1, f2, round(round(CASE WHEN isnan(s) THEN NULL ELSE s END, 12), 6) AS spearman,
       round(round(1.0 - abs(CASE WHEN isnan(s) THEN NULL ELSE s END), 12), 6) AS distance FROM c"""


@register("spearman_wide", _wide_spearman_sql())
def q_spearman_wide(spark, sf):
    return M.rounded(J.spearman_pairs(W.wide_features(fx.raw_mail(spark, sf)).checkpoint(), W.WIDE_FEATURES), settle=12)


@register("within_group_corr_wide", Q._group_corr_sql("within", _wide_spearman_sql(), W.WIDE_FEATURES).replace(
    "round(CASE WHEN n_features >= 2 THEN w END, 6)", "round(round(CASE WHEN n_features >= 2 THEN w END, 12), 6)"))
def q_within_group_corr_wide(spark, sf):
    pairs = J.spearman_pairs(W.wide_features(fx.raw_mail(spark, sf)).checkpoint(), W.WIDE_FEATURES)
    groups = {g: GR.group_columns(g, W.WIDE_FEATURES) for g in GR.GROUP_NAMES}
    return M.rounded(J.within_group_corr(pairs, J.group_positions(spark, groups, W.WIDE_FEATURES)), settle=12)


# --------------------------------------------------------------------------
# H10 whole metric set, A10 / A11 / M1 / M2 CSV round trips
# --------------------------------------------------------------------------
def _fold_metrics_sql() -> str:
    cm, auc, ap, ece = (REGISTERED[n] for n in ("classification_metrics", "roc_auc", "average_precision", "ece"))
    return f"SELECT * FROM ({cm}) a JOIN ({auc}) b USING ({Q._K}) JOIN ({ap}) d USING ({Q._K}) JOIN ({ece}) c USING ({Q._K})"


@register("fold_metrics", _fold_metrics_sql())
def q_fold_metrics(spark, sf):
    return M.rounded(M.all_metrics(fx.scored(spark, sf)), settle=12)


@register("feature_csv_roundtrip", Q._FM + "SELECT mail_id, label, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in fx.FEATURE_MATRIX_FEATURES) + " FROM feature_matrix")
def q_feature_csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "feature-csv")
    SK.export_csv(fx.feature_matrix(spark, sf).select("mail_id", "label", *fx.FEATURE_MATRIX_FEATURES), path)
    back = DOC.read_feature_csv(spark, path)
    return M.rounded(back.withColumn("mail_id", F.col("mail_id").cast("bigint")))


@register("results_csv_roundtrip", Q._RES_SQL + "SELECT dataset, feature_group, model_name, " + ", ".join(
    f"round(round({m}, 12), 6) AS {m}" for m in Q._RES_METRICS) + " FROM res")
def q_results_csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "results-csv")
    SK.export_csv(Q._results(spark, sf), path)
    return M.rounded(DOC.read_results_csv(spark, path)[0], settle=12)


# --------------------------------------------------------------------------
# A16 / M6, I5-I7, G4m-G16m: fitted models
# --------------------------------------------------------------------------
@register("model_roundtrip", O.prefix_for("raw_mail") + "SELECT count(*) AS n, count(*) AS n_equal FROM raw_mail")
def q_model_roundtrip(spark, sf):
    """A model that was written and read back scores every mail as before."""
    (requests, model), path = Q._served(spark, sf), scratch_dir(spark, "model")
    SK.save_model(model, path)
    again = SC.score_v1(requests, SK.load_model(path)).select("email_id", F.struct("prediction", "confidence").alias("again"))
    both = SC.score_v1(requests, model).join(again, "email_id")
    equal = F.struct("prediction", "confidence").eqNullSafe(F.col("again"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(equal, 1)).alias("n_equal"))


@register("importance_roundtrip", "SELECT 3 AS n_top, true AS same, true AS falls, true AS whole WHERE (SELECT count(*) FROM orders) > 0")
def q_importance_roundtrip(spark, sf):
    """Impurity importance written and read back: lookup, top rows, and their sum."""
    path = scratch_dir(spark, "importance")
    imp = IM.mdi_importance(MD.fit_pipeline(Q._fit_rows(spark, sf), Q._MODEL_COLS), spark)
    SK.save_importance(imp, path)
    back = SK.load_importance(spark, path)
    # one row per feature
    before, after = IM.importance_to_dict(imp), IM.importance_to_dict(back)
    top = [r.feature for r in IM.top_n(back, 3).collect()]
    rest = [v for f, v in after.items() if f not in top]
    return spark.createDataFrame([(len(top), before == after, min(after[f] for f in top) >= max(rest),
                                   abs(sum(after.values()) - 1) < 1e-9)], "n_top int, same boolean, falls boolean, whole boolean")


_HELD_SQL = Q._FM + """
, held AS (SELECT mail_id, label FROM (
    SELECT mail_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(mail_id AS VARCHAR) || '42'), mail_id) AS rn,
           count(*) OVER (PARTITION BY label) AS n FROM feature_matrix) t WHERE rn <= ceil(n * 0.2))
SELECT model_name, count(*) AS n, count(DISTINCT mail_id) AS n_mails, CAST(sum(label) AS BIGINT) AS n_positive,
       true AS in_range, true AS consistent, true AS accurate FROM held, (VALUES {models}) m(model_name) GROUP BY model_name"""
#: least share of right predictions on the held-out rows
LEAST_ACCURACY = {"RF": 0.9, "SVM": 0.9, "MLP": 0.85, "KNN": 0.85, "OC_SVM": 0.7, "Stacking": 0.9}


def _held_out(names):
    def build(spark, sf):
        fm = C.impute_median(fx.feature_matrix(spark, sf), Q._MODEL_COLS)
        s = FO.holdout_split(fm, 0.2, 42).checkpoint()
        train, test = s.where("is_test = 0").drop("is_test"), s.where("is_test = 1").drop("is_test")
        parts = MD.in_parallel([lambda m=m: MD.fit_predict(m, train, test, Q._MODEL_COLS).select(
            F.lit(m).alias("model_name"), F.lit(LEAST_ACCURACY[m]).alias("least"), "mail_id", "label", "y_pred", "y_prob") for m in names])
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        right = F.avg((F.col("y_pred") == F.col("label")).cast("double"))
        return u.groupBy("model_name").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("mail_id").alias("n_mails"),
            F.sum("label").cast("bigint").alias("n_positive"), F.every(F.col("y_prob").between(0, 1)).alias("in_range"),
            F.every(F.col("y_pred") == (F.col("y_prob") > 0.5).cast("int")).alias("consistent"),
            (right >= F.max("least")).alias("accurate"))
    return build


for _name, _models in (("model_checks", ("RF", "SVM", "MLP", "KNN", "OC_SVM")), ("stacking_checks", ("Stacking",))):
    register(_name, _HELD_SQL.replace("{models}", ", ".join(f"('{m}')" for m in _models)))(_held_out(_models))
