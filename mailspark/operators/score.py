"""2.L: scoring of feature documents with a fitted ``PipelineModel``.

Requests are rows ``(email_id, headers MAP, header_features MAP, ...)``;
the model's own feature list (its assembler's input columns) decides which
keys are used: missing keys become 0, unparsable values 0, extra keys are
ignored.  Scoring is a ``transform`` (the fitted trees travel with the
task closure), so batch files and file streams are scored the same way.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from mailspark.functions.dates import date_to_utc_iso
from mailspark.functions.headers import class_to_label, to_number

REQUEST_SCHEMA = T.StructType([
    T.StructField("email_id", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("header_features", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body_urls", T.ArrayType(T.StringType())),
])
# --- fixed values -----------------------------------------------------------
FEATURE_VERSION = "G6+G5_v2"
# ---------------------------------------------------------------------------


def model_features(model: PipelineModel) -> list[str]:
    """The feature list carried by the model's assembler stage."""
    for st in model.stages:
        if isinstance(st, VectorAssembler):
            return list(st.getInputCols())
    raise ValueError("model has no VectorAssembler stage")


def header_value(headers: Column, *keys: str) -> Column:
    """Case-insensitive lookup with '-' == '_'; the last entry wins among
    keys that normalise equally; the first non-empty key of ``keys`` is used."""
    def norm(k: Column) -> Column:
        return F.replace(F.lower(k), F.lit("-"), F.lit("_"))
    out = []
    for k in keys:
        nk = k.lower().replace("-", "_")
        hits = F.filter(F.map_entries(headers), lambda e: norm(e["key"]) == F.lit(nk))
        v = F.element_at(hits, -1)["value"]
        out.append(F.when(F.size(hits) > 0, F.nullif(v, F.lit(""))))
    return F.coalesce(*out)


def request_features(requests: DataFrame, features: list[str]) -> DataFrame:
    """L1: one DOUBLE column per model feature from the request map."""
    hf = F.col("header_features")
    return requests.withColumns({f: F.coalesce(to_number(hf[f]), F.lit(0.0)) for f in features})


def _probabilities(requests: DataFrame, model: PipelineModel) -> DataFrame:
    feats = model_features(model)
    rows = request_features(requests, feats)
    if len(model.stages) == 2 and isinstance(model.stages[0], VectorAssembler):
        # the assembler's vector, but with its zeros in place: trees find a value of a sparse one by search
        dense = array_to_vector(F.array(*[F.col(f) for f in feats]))
        scored = model.stages[1].transform(rows.withColumn(model.stages[0].getOutputCol(), dense))
    else:
        scored = model.transform(rows)
    p = vector_to_array("probability")
    return scored.withColumn("_p0", p[0]).withColumn("_p1", p[1])


def score_v1(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """L2: class = argmax (ties -> first class), API label, confidence
    rounded to 4, message id and UTC timestamp from the request headers."""
    s = _probabilities(requests, model)
    cls = F.when(F.col("_p1") > F.col("_p0"), 1).otherwise(0)
    conf = F.greatest("_p0", "_p1")
    return s.select("email_id",
                    header_value(F.col("headers"), "message_id", "Message-ID").alias("message_id"),
                    date_to_utc_iso(header_value(F.col("headers"), "date", "Date")).alias("timestamp"),
                    class_to_label(cls).alias("prediction"), F.round(conf, 4).alias("confidence"))


def score_v2(requests: DataFrame, model: PipelineModel, source_path: str = "") -> DataFrame:
    """L3: malicious / legitimate probabilities, ties -> malicious, feature
    metadata, timestamp = scoring time."""
    feats = model_features(model)
    s = _probabilities(requests, model)
    mal, leg = F.col("_p1"), F.col("_p0")
    is_mal = mal >= leg
    return s.select("email_id",
                    F.coalesce(F.col("headers")["message_id"], F.lit("")).alias("message_id"),
                    F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
                    F.when(is_mal, "malicious").otherwise("legitimate").alias("prediction"),
                    F.round(F.when(is_mal, mal).otherwise(leg), 4).alias("confidence"),
                    F.round(mal, 4).alias("malicious_probability"), F.round(leg, 4).alias("legitimate_probability"),
                    F.lit(source_path).alias("source_path"), F.lit(FEATURE_VERSION).alias("feature_version"),
                    F.lit(len(feats)).alias("feature_count"),
                    F.array(*[F.lit(f) for f in feats]).alias("used_features"))


def detection_rate(scored: DataFrame) -> DataFrame:
    """L4: malicious / legitimate counts and detection rate in percent (1 decimal, 0 if empty)."""
    agg = scored.agg(F.sum((F.col("prediction") == "malicious").cast("long")).alias("malicious"),
                     F.sum((F.col("prediction") == "legitimate").cast("long")).alias("legitimate"),
                     F.count(F.lit(1)).alias("total"))
    return agg.select(F.coalesce("malicious", F.lit(0)).alias("malicious"),
                      F.coalesce("legitimate", F.lit(0)).alias("legitimate"), "total",
                      F.when(F.col("total") > 0, F.round(F.col("malicious") * 100.0 / F.col("total"), 1))
                      .otherwise(0.0).alias("detection_rate"))


def _string_map(docs: DataFrame, column: str) -> Column:
    """The fields of a struct column that are not null, as strings."""
    kind, whole = docs.schema[column].dataType, F.col(column)
    plain = isinstance(kind, T.StructType) and len({f.name for f in kind}) == len(kind) > 0 and all(
        isinstance(f.dataType, (T.StringType, T.IntegerType, T.LongType)) for f in kind)
    if not plain:
        return F.from_json(F.to_json(column), T.MapType(T.StringType(), T.StringType()))
    fields = {f.name: whole.getField(f.name) for f in kind}
    every = F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v.cast("string"))])
    some_null = F.lit(False)
    for v in fields.values():
        some_null = some_null | v.isNull()
    there = F.when(some_null, F.map_filter(every, lambda _, v: v.isNotNull())).otherwise(every)
    return F.when(whole.isNotNull(), there)


def documents_as_requests(docs: DataFrame) -> DataFrame:
    """Feature documents (2.D) -> request rows with string maps."""
    return docs.select("email_id", _string_map(docs, "headers").alias("headers"),
                       _string_map(docs, "header_features").alias("header_features"),
                       F.array().cast("array<string>").alias("body_urls"))
