"""Queries over archives and document folders that the library did not write
itself: their bytes come from plain text writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailspark import oracle as O
from mailspark.catalog import register
from mailspark.operators import compact as CP
from mailspark.plans.dataset import upgrade_folder
from mailspark.session import scratch_dir
from mailspark.sources import documents as DOC
from mailspark.sources import fixtures as fx
from mailspark.sources import mail as ML

# --------------------------------------------------------------------------
# Archives of four kinds: text before the first message; CRLF; no empty
# lines between messages and quoted lines in bodies; 8-bit bytes
# --------------------------------------------------------------------------
_MAILS_PER_RANGE = 20000  # of mail ids; each range is four archives, one of each kind
_TAIL = {0: "", 1: "", 2: "From here on\n>From there\n", 3: "caf\u00c3\u00a9\n"}  # bodies' ends as they are read
_WRITTEN = {0: "\n", 1: "\n", 2: ">From here on\n>>From there\n", 3: "caf\u00e9\n\n"}  # and as they are written


def _sql_text(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c == "\n" or ord(c) > 126 else f"'{c}'" for c in s) or "''"


@register("mbox_foreign", O.prefix_for("raw_mail") + f"""
SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY mail_id) - 1 AS INTEGER) AS pos, 1 AS label,
       CAST(length(m) AS INTEGER) AS n_chars, md5(m) AS digest
FROM (SELECT mail_id, CAST(mail_id // {_MAILS_PER_RANGE} * 4 + mail_id % 4 AS INTEGER) AS archive,
             CASE mail_id % 4 WHEN 1 THEN replace(raw || chr(10), chr(10), chr(13) || chr(10))
             {" ".join(f"WHEN {k} THEN raw || chr(10) || {_sql_text(t)}" for k, t in _TAIL.items() if k != 1)} END AS m FROM raw_mail)""")
def q_mbox_foreign(spark, sf):
    root = scratch_dir(spark, "archives")
    kind = F.col("mail_id") % 4
    archive = (F.floor(F.col("mail_id") / _MAILS_PER_RANGE) * 4 + kind).cast("int")
    text = F.concat(F.lit("From someone@corp.example Thu Jan  1 00:00:00 2015\n"), F.col("raw"), F.lit("\n"))
    for k, tail in _WRITTEN.items():
        text = F.when(kind == k, F.concat(text, F.lit(tail))).otherwise(text)
    text = F.when(kind == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    # the writer ends each value with LF
    mails = fx.raw_mail(spark, sf).select(archive.alias("archive"), "mail_id", F.regexp_replace(text, r"\n\z", "").alias("value"))
    notes = mails.where(kind == 0).select("archive", F.lit(-1).cast("long").alias("mail_id"),
                                          F.lit("An archive of messages\nand no message yet").alias("value")).distinct()
    rows = mails.unionByName(notes).repartition("archive").sortWithinPartitions("archive", "mail_id")
    rows.select("archive", "value").write.partitionBy("archive").option("lineSep", "\n").text(root)
    got = ML.read_mbox(spark, root, label=1, unquote=True)
    return got.select(F.regexp_extract("path", r"/archive=(\d+)/", 1).cast("int").alias("archive"),
                      F.regexp_extract("mail_id", r"_(\d+)$", 1).cast("int").alias("pos"), "label",
                      F.length("raw").cast("int").alias("n_chars"), F.md5("raw").alias("digest"))


# --------------------------------------------------------------------------
# A document per file, with 16 or 24 features, some files broken
# --------------------------------------------------------------------------
_VALUE = {c: f"(s_suppkey * {i + 3}) % 7 - 1" for i, c in enumerate(CP.COMPACT_FEATURES)}


def _fields_sql(cols: list[str]) -> str:
    return " || ', ' || chr(10) || ".join(f"'    \"{c}\": ' || cast({_VALUE[c]} as string)" for c in cols)


# doubled braces: the text goes through a formatter twice
_DOCUMENT = f"""
select s_suppkey as k, case when s_suppkey % 7 = 3 then substr(doc, 1, 90) else doc end as value
from (select s_suppkey, '{{{{' || chr(10) || '  "email_id": "doc_' || cast(s_suppkey as string) || '",' || chr(10)
        || '  "headers": {{{{"date": "", "message_id": "<' || cast(s_suppkey as string) || '@corp.example>"}}}},' || chr(10)
        || '  "header_features": {{{{' || chr(10) || {_fields_sql(CP.HEADER16)}
        || case when s_suppkey % 3 = 0 then ', ' || chr(10) || {_fields_sql(CP.AUTH8)} else '' end
        || '}}}},' || chr(10) || '  "unknown": [1, {{{{"a": null}}}}],' || chr(10)
        || '  "body_text": "", "attachments": []' || chr(10) || '}}}}' as doc from {{supplier}}) t"""


def _value_sql(c: str) -> str:
    kept = _VALUE[c] if c in CP.HEADER16 else f"CASE WHEN s_suppkey % 3 = 0 THEN {_VALUE[c]} ELSE 0 END"
    return f"CAST(CASE WHEN s_suppkey % 7 <> 3 THEN {kept} END AS INTEGER) AS {c}"


@register("document_files", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 3 THEN 'broken' WHEN s_suppkey % 3 = 0 THEN 'unchanged' "
          "ELSE 'upgraded' END AS status, CASE WHEN s_suppkey % 7 <> 3 THEN '<' || s_suppkey || '@corp.example>' END AS message_id, "
          + ", ".join(_value_sql(c) for c in CP.COMPACT_FEATURES) + " FROM supplier")
def q_document_files(spark, sf):
    """A row per file: what the rewritten folder holds of it, nulls for a broken one."""
    src, dst = scratch_dir(spark, "document-files"), scratch_dir(spark, "upgraded")
    docs = spark.sql(_DOCUMENT, supplier=fx.table(spark, sf, "supplier"))
    docs.select("value", F.col("k").alias("n")).repartition("n").write.partitionBy("n").text(src)
    report = upgrade_folder(spark, src, dst)
    back = DOC.read_documents(spark, dst, multiline=False).select("email_id", "headers.message_id", "header_features.*")
    return report.withColumn("k", F.regexp_extract("source_path", r"/n=(\d+)/", 1).cast("bigint")).join(back, "email_id", "left") \
        .select("k", "status", "message_id", *CP.COMPACT_FEATURES)
