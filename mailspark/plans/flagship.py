"""The flagship query: raw mail -> 81 header features -> per-class profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailspark.operators import correlate as J
from mailspark.operators import wide as W
from mailspark.sources import fixtures as fx


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every wide header feature per class (J6 over C-ALL)."""
    feats = W.wide_features(fx.raw_mail(spark, sf_dir))
    return J.class_means(feats, W.WIDE_FEATURES)
