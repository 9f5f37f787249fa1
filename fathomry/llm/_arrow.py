"""Helpers for the Arrow-batched Python stages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and bytes of an Arrow batch handed to Python: texts can be very long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for documents of any length.

    The plan reads these settings when it runs, which is after the operator returned, so they stay in the session.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_bytes(df: DataFrame, column: str = "text") -> DataFrame:
    """Replace a string column by its UTF-8 bytes, so Python neither decodes nor encodes it."""
    return df.withColumn(column, F.col(column).cast("binary"))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
