"""Queries of this package: one per operator and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from mailspark.llm import (best_fit, bit_planes, crf_pii, decontaminate, edit_counts, golomb_dedup,
                           importance_resampling, line_quality, orchard_codes, reply_trees, simhash_variants, url_rules,
                           weak_labels)
from mailspark.llm.common import read


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_edit_counts": _on_documents(edit_counts.op1_edit_counts),
        "op2_crf_pii": _on_documents(crf_pii.op2_crf_pii),
        "op3_weak_labels": _on_documents(weak_labels.op3_weak_labels),
        "op4_reply_trees": reply_trees.op4_reply_trees,
        "op5_url_rules": url_rules.op5_url_rules,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_best_fit": _on_documents(best_fit.op7_best_fit),
        "op8_bit_planes": _on_documents(bit_planes.op8_bit_planes),
        "op9_line_quality": _on_documents(line_quality.op9_line_quality),
        "op10_simhash": _on_documents(simhash_variants.op10_simhash),
        "op11_orchard_codes": lambda spark, sf_dir: orchard_codes.op11_orchard_codes(read(spark, sf_dir, "embeddings")),
        "op12_golomb_dedup": _on_documents(golomb_dedup.op12_golomb_dedup),
        "op13_importance_resampling": importance_resampling.op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op4_reply_trees": reply_trees.ORACLE,
        "op5_url_rules": url_rules.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op9_line_quality": line_quality.ORACLE,
        "op11_orchard_codes": orchard_codes.ORACLE,
        "op12_golomb_dedup": golomb_dedup.ORACLE,
        "op13_importance_resampling": importance_resampling.ORACLE,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
