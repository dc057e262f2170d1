"""mailspark: e-mail header analytics as Spark jobs.

Layout
------
functions/  Column -> Column primitives (header split, lookups, dates, domains)
operators/  feature extractors, cleaning, folds, models, metrics, reports
sources/    raw mail, mbox, JSON documents, CSV tables, derived fixtures
plans/      multi-step jobs (dataset build, experiment matrix, report)
streaming/  file-stream scoring
"""

from mailspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
