"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: id stored for a null document id where a join key must not be null
NULL_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def arrow_struct(fn, schema: str):
    """Arrow UDF ``texts -> struct`` over a per-text function returning a tuple
    in the order of ``schema``.  Null texts reach ``fn`` as the empty string.

    Marked non-deterministic so that a later filter on a field does not run
    the function a second time.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark_type = _parse_datatype_string(schema)
    arrow_type = to_arrow_type(spark_type)
    names = [f.name for f in spark_type.fields]

    def run(texts: pa.Array) -> pa.Array:
        rows = [fn(t.as_py() or "") for t in texts]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        arrays = [pa.array(list(col), type=f.type) for col, f in zip(cols, arrow_type)]
        return pa.StructArray.from_arrays(arrays, fields=list(arrow_type))

    return F.arrow_udf(run, spark_type).asNondeterministic()
