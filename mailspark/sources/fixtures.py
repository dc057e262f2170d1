"""Mail-shaped relations derived from the supplied ``orders`` table.

The supplied tables hold no mail, so the test and bench inputs are derived
from ``orders`` with SQL written in the common subset of Spark SQL and
DuckDB.  The same text builds the Spark input (``spark.sql`` with the
``orders`` DataFrame bound to ``{orders}``) and the oracle's CTE, so every
query's work grows with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_MAIL_SQL = """
select o_orderkey as mail_id,
       'corpus/' || case when o_orderkey % 3 = 0 then 'spam' else 'ham' end || '/' || lpad(cast(o_orderkey as string), 9, '0') as path,
       case when o_orderkey % 3 = 0 then 1 else 0 end as label,
  case when o_orderkey % 10 < 8 then 'Received: from mx' || cast(o_custkey % 5 as string) || '.corp' || cast(o_custkey % 7 as string) || '.example (unknown [10.' || cast(o_custkey % 250 as string) || '.0.1])' || chr(10) || chr(9) || 'by relay.example.net; ' || dt || ' +0000' || chr(10) else '' end
  || case when o_orderkey % 4 = 1 then 'Received: garbled hop ' || cast(o_custkey % 200 as string) || '.168.1.9 +0530' || chr(10) else '' end
  || case when o_orderkey % 7 < 3 then 'received: from corp' || cast(o_custkey % 7 as string) || '.example by mx1.example.org; ' || dt || ' +0000' || chr(10) else '' end
  || case when o_orderkey % 6 < 4 then 'Return-Path: <b@corp' || cast(o_orderkey % 7 as string) || '.example>' || chr(10) else '' end
  || 'From: "User ' || cast(o_custkey as string) || '" <u' || cast(o_custkey as string) || '@corp' || cast(o_custkey % 7 as string) || '.example>' || chr(10)
  || case when o_orderkey % 20 = 3 then '' else 'To: a@corp' || cast(o_orderkey % 7 as string) || '.example' || case when o_orderkey % 8 = 5 then ', b@other.example' else '' end || chr(10) end
  || case when o_orderkey % 11 = 1 then 'Cc: c@x.example, d@y.example' || chr(10) else '' end
  || case when o_orderkey % 5 = 0 then 'Reply-To: r@' || case when o_orderkey % 2 = 0 then 'sub.' else '' end || 'corp' || cast(o_custkey % 3 as string) || '.example' || chr(10) else '' end
  || 'Subject: ' || case when o_orderkey % 6 = 0 then 'RE: ' else '' end || o_orderpriority || case when o_orderkey % 9 = 0 then '!!?' else '' end || chr(10)
  || case when o_orderkey % 13 = 0 then '' else 'Date: ' || case when o_orderkey % 50 = 7 then 'not a date' when o_orderkey % 25 = 4 then '01 Jan 1990 10:20:30 +0000' else dt || case when o_orderkey % 3 = 0 then ' -0400' else ' +0000' end end || chr(10) end
  || case o_orderkey % 9 when 0 then '' when 1 then 'Message-ID: broken-' || cast(o_orderkey as string) || chr(10) else 'Message-ID: <' || cast(o_orderkey as string) || '@corp' || cast(o_custkey % 7 as string) || '.example>' || chr(10) end
  || case when o_orderkey % 2 = 0 then 'Authentication-Results: mx.example; spf=' || case o_orderkey % 8 when 0 then 'pass' when 2 then 'softfail' when 4 then 'none' else 'neutral;' end || '; dkim=pass' || case when o_orderkey % 16 = 0 then '; dmarc=pass' else '' end || chr(10) else '' end
  || case when o_orderkey % 10 = 9 then 'ARC-Authentication-Results: i=1; dmarc=fail' || chr(10) else '' end
  || case when o_orderkey % 12 < 5 then 'DKIM-Signature: v=1; a=rsa-sha256; d=corp.example; s=k; h=from; bh=x; b=y' || chr(10) when o_orderkey % 12 = 5 then 'DKIM-Signature: broken' || chr(10) else '' end
  || case when o_orderkey % 4 = 2 then 'X-Priority: ' || cast(o_custkey % 5 + 1 as string) || ' (x)' || chr(10) else '' end
  || case when o_orderkey % 5 = 2 then 'X-Spam-Status: Yes, score=' || case when o_orderkey % 2 = 0 then '-1.5' else '7.25' end || ' required=5' || chr(10) else '' end
  || case when o_orderkey % 6 = 5 then 'Precedence: ' || case when o_custkey % 2 = 0 then 'Bulk' else 'first-class' end || chr(10) || 'List-Unsubscribe: <mailto:u@l.example>' || chr(10) else '' end
  || case when o_orderkey % 7 = 4 then 'X-Mailer: M ' || o_orderstatus || chr(10) else '' end
  || case o_orderkey % 4 when 0 then 'MIME-Version: 1.0' || chr(10) || 'Content-Type: text/html; charset=x' || chr(10) || 'Content-Transfer-Encoding: BASE64' || chr(10) when 1 then 'MIME-Version: 1.0' || chr(10) || 'Content-Type: multipart/mixed' || chr(10) else '' end
  || chr(10) || 'body ' || o_orderstatus as raw
from (select *, lpad(cast(day(o_orderdate) as string), 2, '0') || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) * 3 - 2 as int), 3)
             || ' ' || cast(year(o_orderdate) as string) || ' 10:20:30' as dt
      from {orders}) t
"""

SCORED_SQL = """
select o_orderkey as mail_id,
       case when o_custkey % 2 = 0 then 'A' else 'B' end as dataset,
       'G' || cast(o_orderkey % 3 + 1 as string) as feature_group,
       case when o_orderkey % 4 < 2 then 'RF' else 'KNN' end as model_name,
       cast(o_custkey % 5 as int) as fold,
       cast(y as int) as y_true,
       cast(case when p >= 50 then 1 else 0 end as int) as y_pred,
       cast(p as double) / 100.0 as y_prob
from (select *, case when (o_orderkey * 31 + o_custkey * 17) % 101 + case when o_orderkey % 3 = 0 then 25 else 0 end > 100 then 100
                     else (o_orderkey * 31 + o_custkey * 17) % 101 + case when o_orderkey % 3 = 0 then 25 else 0 end end as p,
             case when o_orderkey % 3 = 0 then 1 else 0 end as y
      from {orders}) t
"""

FEATURE_MATRIX_SQL = """
select o_orderkey as mail_id,
       cast(case when o_orderkey % 3 = 0 then 1 else 0 end as int) as label,
       case when o_orderkey % 17 = 0 then null else o_totalprice end as subject_len,
       cast(o_custkey % 9 + case when o_orderkey % 3 = 0 then 4 else 0 end as double) as n_received_hops,
       cast(length(o_orderpriority) as double) as mid_len,
       cast(case when o_orderkey % 3 = 0 and o_custkey % 4 < 3 then -1 when o_custkey % 5 < 3 then 1 else 0 end as double) as spf_result,
       cast(case when o_orderkey % 10 < 7 then 1 else 0 end as double) as has_reply_to,
       cast(case when o_orderkey % 400 = 0 then 1 else 0 end as double) as from_non_ascii,
       cast(1 as double) as has_from,
       o_orderstatus as raw_status,
       o_orderpriority as _source_file
from {orders}
"""

# numeric feature columns of the derived feature_matrix (label and ids excluded)
FEATURE_MATRIX_FEATURES = ["subject_len", "n_received_hops", "mid_len", "spf_result",
                           "has_reply_to", "from_non_ascii", "has_from"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    # The supplied file is one row group, i.e. one scan task.  The per-mail
    # work downstream is CPU-bound, so spread the (narrow) order rows over
    # the cluster first; a deterministic hash on the key keeps retries exact.
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return spark.sql(sql, orders=orders)


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_mail(mail_id, path, label, raw)`` with one RFC-2822 text per order."""
    return _derive(spark, sf_dir, RAW_MAIL_SQL)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions``-shaped table: one scored mail per order."""
    return _derive(spark, sf_dir, SCORED_SQL)


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature table with nulls, a rare flag, a constant and a string column."""
    return _derive(spark, sf_dir, FEATURE_MATRIX_SQL)


def oracle_cte(**named_sql: str) -> str:
    """``WITH name AS (...)`` prefix for the DuckDB oracle (views are pre-registered)."""
    parts = [f"{n} AS ({s.format(orders='orders')})" for n, s in named_sql.items()]
    return "WITH " + ",\n".join(parts) + "\n"
