"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.storage import shared_dir, stored

__all__ = ["BROADCAST_BYTES", "bounded_batches", "broadcast_if_small", "byte_slices", "in_training", "reducers", "shared_dir", "stored", "table"]

#: Measured bytes of a table that may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer scan tasks than cores is dealt over all cores (its files are small,
    and a row group can't be split otherwise)."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def _width(kind: T.DataType, column) -> Column:
    """Bytes of a value, without overhead."""
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, column[f.name]) for f in kind.fields), F.lit(8))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    return F.lit(8) if isinstance(kind, T.AtomicType) else F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 64


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a (stored) table for broadcast when its rows and values, measured, are within the bound."""
    each = sum((_width(f.dataType, df[f.name]) for f in df.schema.fields), F.lit(8))
    size = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def byte_slices(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row of a string column; a null gives empty bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    for k, missing in enumerate(nulls.tolist()):
        yield b"" if missing else bytes(data[offsets[k] : offsets[k + 1]])


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_BYTES (or one row), so that a worker's
    memory doesn't depend on how long texts are. Sets the session's limit where it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_training(doc_id="doc_id"):
    """True for documents that models may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(True))


def reducers(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
