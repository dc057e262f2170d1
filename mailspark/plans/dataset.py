"""Entry point 2: raw mail folders -> processed feature tables (3.2), and the
real-or-synthetic source resolution of the experiment runner (A15)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark import sinks
from mailspark.operators.clean import clean_and_encode
from mailspark.operators.compact import upgrade_documents
from mailspark.operators.wide import wide_features
from mailspark.sources.documents import DOC_SCHEMA, read_documents
from mailspark.sources.mail import cap_per_class, read_mail_dir
from mailspark.sources.synthetic import generate_synthetic

# --- fixed values: class folders of each dataset ---------------------------
DATASET_CLASSES = {"A": ("ham", "spam"), "B": ("ham", "phishing")}
# ---------------------------------------------------------------------------


def build_dataset(spark: SparkSession, root: str, dataset: str = "A", out_path: str | None = None,
                  max_per_class: int | None = None, clip_mode: str = "reference") -> tuple[DataFrame, list[str]]:
    """binaryFile -> 81 features -> cleaning -> (optional) Parquet.

    Only the dataset's class folders are read (a flat folder is all ham);
    no mail at all is an error.  Returns the table and the dropped columns."""
    classes = DATASET_CLASSES[dataset.upper()]
    present = [c for c in classes if _exists(spark, f"{root.rstrip('/')}/{c}")]
    raw = (read_mail_dir(spark, root) if not present else
           _union([read_mail_dir(spark, f"{root.rstrip('/')}/{c}")
                   .withColumn("label", F.lit(0 if c == "ham" else 1).cast("int")) for c in present]))
    if max_per_class:
        raw = cap_per_class(raw, max_per_class)
    if raw.limit(1).count() == 0:
        raise FileNotFoundError(f"no mail files found in {root}")
    feats = wide_features(raw)
    table, dropped = clean_and_encode(feats, dataset, clip_mode=clip_mode)
    if out_path:
        sinks.write_table(table, out_path)
    return table, dropped


def upgrade_folder(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """D6 + M4: a folder of feature documents, one JSON object per file, rewritten
    to the new folder ``dst`` with all 24 features (JSON lines, many documents per file).

    Returns a row per file: ``source_path``, ``email_id`` and ``status``: ``upgraded`` (16 features before),
    ``unchanged``, or ``broken`` (not a document: left out of ``dst``, no id)."""
    docs = read_documents(spark, src, corrupt="_corrupt")
    good = upgrade_documents(docs.where(F.col("_corrupt").isNull()))
    sinks.write_documents(good.select(*DOC_SCHEMA.names), dst)
    broken = F.col("_corrupt").isNotNull()
    status = F.when(broken, "broken").when(F.col("header_features.spf_result").isNull(), "upgraded").otherwise("unchanged")
    return docs.select("source_path", F.when(~broken, F.col("email_id")).alias("email_id"), status.alias("status"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prepare_datasets(spark: SparkSession, roots: dict[str, str] | None = None, n_ham: int = 1000,
                     n_spam: int = 1000, max_per_class: int | None = None, seed: int = 42, synthetic: bool = False) -> dict[str, DataFrame]:
    """The real corpus of each named root; a root that is missing or fails
    to build raises.  Only with ``synthetic`` a dataset without a root is
    generated (B has half the size of A)."""
    out: dict[str, DataFrame] = {}
    for ds in ("A", "B"):
        root = (roots or {}).get(ds)
        if root:
            if not _exists(spark, root):
                raise FileNotFoundError(f"no mail folder for dataset {ds}: {root}")
            out[ds] = build_dataset(spark, root, ds, max_per_class=max_per_class)[0]
            continue
        if not synthetic:
            raise ValueError(f"no root for dataset {ds}; pass synthetic=True for a generated table")
        nh, ns = (n_ham, n_spam) if ds == "A" else (n_ham // 2, n_spam // 2)
        out[ds] = generate_synthetic(spark, nh, ns, ds, seed)
    return out
