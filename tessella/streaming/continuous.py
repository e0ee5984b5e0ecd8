"""Filter, projection and stream-static join over streams; an addition to the batch engine.

The operators of :mod:`tessella.operators.relational` build the same plans over a streaming
DataFrame, so only source and sink differ.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.frame import Frame


def stream(spark: SparkSession, folder: str, schema: T.StructType) -> Frame:
    """New Parquet files of a folder, as they come."""
    return Frame.of(spark.readStream.schema(schema).parquet(folder))


def write_stream(frame: Frame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the rows to a folder exactly once; stops when all present input is done."""
    return frame.to_df().writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
