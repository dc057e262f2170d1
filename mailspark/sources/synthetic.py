"""Synthetic labelled feature tables, generated on the executors.

``spark.range`` provides the rows (n_ham zeros then n_spam ones); every
column is drawn from its own seeded ``rand``/``randn`` stream: Bernoulli
flags, normal values clipped at 0 (integer columns truncated) and
categorical draws from one uniform.  The distributions follow the
reference's generator; the random bits do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- fixed values: (column, kind, ham parameters, spam parameters) ---------
# kinds: "b" Bernoulli(p); "n" / "ni" normal(mu, sd) clipped at 0 (ni: as int);
# "c" categorical (values, ham probabilities, spam probabilities)
SPEC = [
    ("has_received", "b", 0.99, 0.90), ("has_message_id", "b", 0.99, 0.75), ("has_date", "b", 1.00, 0.95),
    ("has_from", "b", 1.00, 0.99), ("has_to", "b", 0.98, 0.85), ("has_reply_to", "b", 0.30, 0.70),
    ("has_return_path", "b", 0.90, 0.60), ("has_mime_version", "b", 0.95, 0.80),
    ("has_content_type", "b", 0.99, 0.95), ("has_content_transfer_encoding", "b", 0.85, 0.78),
    ("has_subject", "b", 0.99, 0.97), ("has_x_mailer", "b", 0.50, 0.35),
    ("has_x_originating_ip", "b", 0.30, 0.55), ("has_x_spam_status", "b", 0.60, 0.40),
    ("has_dkim_signature", "b", 0.70, 0.30), ("has_domainkey_signature", "b", 0.20, 0.10),
    ("has_authentication_results", "b", 0.75, 0.40), ("has_arc_authentication_results", "b", 0.40, 0.20),
    ("has_delivered_to", "b", 0.70, 0.45), ("has_envelope_to", "b", 0.30, 0.25),
    ("has_errors_to", "b", 0.15, 0.30), ("has_list_unsubscribe", "b", 0.40, 0.55),
    ("has_precedence", "b", 0.35, 0.50), ("has_x_priority", "b", 0.20, 0.55),
    ("has_spf", "b", 0.85, 0.50), ("has_dkim", "b", 0.70, 0.30), ("has_dmarc", "b", 0.65, 0.25),
    ("from_domain_len", "n", (12, 4), (18, 4)),
    ("from_eq_reply_to_domain", "b", 0.85, 0.20), ("from_eq_return_path_domain", "b", 0.90, 0.25),
    ("from_eq_mid_domain", "b", 0.88, 0.30), ("from_eq_first_received_domain", "b", 0.80, 0.35),
    ("reply_to_present_and_differs", "b", 0.10, 0.65), ("return_path_present_and_differs", "b", 0.08, 0.60),
    ("to_domain_eq_from_domain", "b", 0.30, 0.20), ("mid_domain_eq_from_domain", "b", 0.88, 0.30),
    ("envelope_to_eq_from_domain", "b", 0.50, 0.35), ("reply_to_subdomain_of_from", "b", 0.15, 0.05),
    ("n_received_hops", "ni", (3, 2), (6, 2)), ("missing_received", "b", 0.01, 0.12),
    ("malformed_received_hops", "ni", (0, 1), (1.5, 1)), ("n_unique_hop_ips", "ni", (2, 1.5), (4, 1.5)),
    ("n_private_ips_in_received", "ni", (0.5, 1), (1.5, 1)), ("tz_mismatch_in_received", "b", 0.05, 0.40),
    ("n_unique_tz_offsets", "ni", (1, 1), (2.5, 1)), ("has_unusual_tz", "b", 0.03, 0.35),
    ("n_hop_domains", "ni", (3, 2), (5, 2)), ("date_vs_received_anomaly", "b", 0.02, 0.25),
    ("excessive_hops", "b", 0.01, 0.15),
    ("duplicate_headers", "ni", (0, 1), (1.5, 1)), ("subject_non_ascii", "b", 0.05, 0.30),
    ("from_non_ascii", "b", 0.02, 0.25), ("malformed_date", "b", 0.01, 0.20),
    ("subject_len", "n", (35, 20), (55, 20)), ("subject_has_re", "b", 0.25, 0.10),
    ("subject_all_caps", "b", 0.02, 0.20), ("subject_exclaim_count", "n", (0.1, 1), (2.0, 1)),
    ("subject_question_count", "n", (0.1, 0.5), (0.8, 0.5)), ("is_base64_encoded", "b", 0.30, 0.55),
    ("is_quoted_printable", "b", 0.45, 0.30), ("mid_malformed", "b", 0.02, 0.40),
    ("mid_len", "n", (50, 20), (35, 20)), ("is_multipart", "b", 0.70, 0.55),
    ("is_html_only", "b", 0.15, 0.55), ("total_header_count", "n", (18, 5), (12, 5)),
    ("spf_result", "c", [1, 0, -1], [0.80, 0.15, 0.05], [0.20, 0.30, 0.50]),
    ("dkim_result", "c", [1, 0, -1], [0.75, 0.20, 0.05], [0.15, 0.35, 0.50]),
    ("dmarc_result", "c", [1, 0, -1], [0.70, 0.25, 0.05], [0.15, 0.40, 0.45]),
    ("dkim_signature_present", "b", 0.70, 0.30), ("dkim_signature_valid_format", "b", 0.68, 0.20),
    ("auth_results_present", "b", 0.75, 0.40), ("all_auth_pass", "b", 0.65, 0.10),
    ("any_auth_fail", "b", 0.05, 0.55),
    ("x_mailer_len", "n", (20, 10), (10, 10)),
    ("x_priority_value", "c", [1, 2, 3, 4, 5], [0.05, 0.10, 0.70, 0.10, 0.05], [0.30, 0.20, 0.30, 0.10, 0.10]),
    ("is_bulk_precedence", "b", 0.15, 0.55), ("list_unsubscribe_len", "n", (40, 30), (80, 30)),
    ("n_to_addresses", "ni", (1, 2), (3, 2)), ("n_cc_addresses", "ni", (0.5, 1), (0.3, 1)),
    ("n_bcc_addresses", "ni", (0.1, 0.5), (0.5, 0.5)), ("x_spam_score", "n", (-1.5, 3.0), (6.0, 3.0)),
]
# dataset B: these routing columns are multiplied by a Bernoulli(0.4) draw each
B_MASKED = ["n_received_hops", "tz_mismatch_in_received", "has_unusual_tz", "n_unique_tz_offsets"]
B_KEEP_P = 0.4
# ---------------------------------------------------------------------------


def _column(spec: tuple, label: Column, seed: int) -> Column:
    name, kind = spec[0], spec[1]
    spam = label == 1
    if kind == "b":
        p = F.when(spam, F.lit(spec[3])).otherwise(F.lit(spec[2]))
        return (F.rand(seed) < p).cast("int")
    if kind in ("n", "ni"):
        (mh, sh), (ms, ss) = spec[2], spec[3]
        v = F.greatest(F.randn(seed) * F.when(spam, ss).otherwise(sh) + F.when(spam, ms).otherwise(mh), F.lit(0.0))
        return v.cast("int") if kind == "ni" else v
    if kind == "c":
        values, ph, ps = spec[2], spec[3], spec[4]
        u = F.rand(seed)
        expr, acc_h, acc_s = None, 0.0, 0.0
        for v, a, b in zip(values[:-1], ph[:-1], ps[:-1]):
            acc_h, acc_s = acc_h + a, acc_s + b
            cond = u < F.when(spam, acc_s).otherwise(acc_h)
            expr = F.when(cond, v) if expr is None else expr.when(cond, v)
        return expr.otherwise(values[-1]).cast("int")
    raise ValueError(kind)


def generate_synthetic(spark: SparkSession, n_ham: int, n_spam: int, dataset: str = "A", seed: int = 42,
                       num_partitions: int | None = None) -> DataFrame:
    """``mail_id``, ``label`` and the 81 synthetic feature columns."""
    n = n_ham + n_spam
    base = spark.range(0, n, 1, num_partitions or spark.sparkContext.defaultParallelism)
    label = (F.col("id") >= n_ham).cast("int")
    df = base.select(F.col("id").alias("mail_id"), label.alias("label"))
    df = df.select("mail_id", "label", *[_column(s, F.col("label"), seed * 1000 + i).alias(s[0])
                                         for i, s in enumerate(SPEC)])
    if dataset.upper() == "B":
        df = df.withColumns({c: F.col(c) * (F.rand(seed * 7919 + j) < B_KEEP_P).cast("int")
                             for j, c in enumerate(B_MASKED)})
    return df


def synthetic_pair(spark: SparkSession, n_ham: int = 1000, n_spam: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """Dataset A at full size and B at half size."""
    return {"A": generate_synthetic(spark, n_ham, n_spam, "A", seed),
            "B": generate_synthetic(spark, n_ham // 2, n_spam // 2, "B", seed + 1)}


# --- fixed values: the served model's fallback training table ---------------
FALLBACK_CONSTANT = {"has_message_id": 1, "has_date": 1, "has_from": 1, "has_to": 1, "has_subject": 1,
                     "has_content_type": 1, "has_mime_version": 1, "has_x_originating_ip": 0,
                     "is_base64_encoded": 0, "malformed_date": 0, "mid_malformed": 0, "has_x_priority": 0}
FALLBACK_CHOICE = {
    "has_reply_to": ([0, 1], [0.5, 0.5]), "has_x_mailer": ([0, 1], [0.5, 0.5]),
    "n_received_hops": ([2, 3, 4, 5, 6], [0.2, 0.2, 0.2, 0.2, 0.2]),
    "spf_result": ([1, 0, -1], [0.6, 0.3, 0.1]), "dkim_result": ([1, 0, -1], [0.6, 0.3, 0.1]),
    "dmarc_result": ([1, 0, -1], [0.6, 0.3, 0.1]),
    "dkim_signature_present": ([0, 1], [0.3, 0.7]), "dkim_signature_valid_format": ([0, 1], [0.3, 0.7]),
    "auth_results_present": ([0, 1], [0.3, 0.7]), "all_auth_pass": ([0, 1], [0.4, 0.6]),
    "any_auth_fail": ([0, 1], [0.7, 0.3]), "label": ([0, 1], [0.5, 0.5]),
}
FALLBACK_SUBJECT_LEN = (30, 15)  # normal(mu, sd), truncated to int (not clipped)
# ---------------------------------------------------------------------------


def _choice(values: list, probs: list, seed: int) -> Column:
    u = F.rand(seed)
    expr, acc = None, 0.0
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        expr = F.when(u < acc, v) if expr is None else expr.when(u < acc, v)
    return expr.otherwise(values[-1]).cast("int")


def fallback_training_table(spark: SparkSession, n: int = 2000, seed: int = 42) -> DataFrame:
    """24-feature table whose labels are independent of the features
    (the served model's fallback when no labelled table exists)."""
    from mailspark.operators.compact import COMPACT_FEATURES
    base = spark.range(0, n, 1, spark.sparkContext.defaultParallelism)
    cols = {c: F.lit(v).cast("int") for c, v in FALLBACK_CONSTANT.items()}
    cols.update({c: _choice(v, p, seed * 100 + i) for i, (c, (v, p)) in enumerate(FALLBACK_CHOICE.items())})
    mu, sd = FALLBACK_SUBJECT_LEN
    cols["subject_len"] = (F.randn(seed * 100 + 99) * sd + mu).cast("int")
    return base.select(F.col("id").alias("mail_id"), cols["label"].alias("label"),
                       *[cols[c].alias(c) for c in COMPACT_FEATURES])
