"""Sorting beyond memory, numbers and ranks without a single-task window, and the order check.

Defined results: nulls come first; ties are numbered in any order; an empty input gives no rows, no
violations and an empty file; a null has no order, so it is no violation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.storage import Store, arrow_store, stored

_LOCAL = (1 << 33) - 1
#: Bytes of a raw file that a task reads at once.
CHUNK = 8 << 20


def sort_ascending(df: DataFrame, *columns: str) -> DataFrame:
    """All rows in ascending order (range exchange, then sorts that spill)."""
    return df.orderBy(*columns)


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Rows with numbers from ``start`` on, without gaps, in the order of the partitions.

    The rows are written once. Numbers within a partition follow from the written order; how many
    rows stand before a partition comes from one count a partition.
    """
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row of 16 bytes a partition: small enough for one task, and for a broadcast
    before = counts.selectExpr("_part", "sum(_n) over (order by _part rows between unbounded preceding and current row) - _n as _before")
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOCAL)) + start).cast("long").alias(name))


def ranked(df: DataFrame, *columns: str, rank: str = "rn") -> DataFrame:
    """Rows with their 1-based position in ascending order."""
    return numbered(df.orderBy(*columns), rank, 1)


def ranked_within(df: DataFrame, keys: list[str], order: str, rank: str) -> DataFrame:
    """Rows with their 1-based position, by ``order``, among those of equal keys (nulls are equal).

    A key of any number of rows is spread over the range partitions; the window that adds up its
    counts has one row for each partition and key.
    """
    placed = stored(df.orderBy(*keys, order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part"), *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.struct(*keys).alias("_keys"), "_part", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    same = (F.shiftright("_at", 33) == F.col("_part")) & F.struct(*keys).eqNullSafe(F.col("_keys"))
    return placed.join(before, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(rank))


def order_violations(rows: DataFrame, value: str, rank: str = "rn") -> DataFrame:
    """One row, ``violations``: how many ranks have a smaller value than the rank before."""
    here = rows.select(F.col(rank).alias("_rank"), F.col(value).alias("_value"))
    before = rows.select((F.col(rank) + 1).alias("_rank"), F.col(value).alias("_before"))
    return here.join(before, "_rank").agg(F.coalesce(F.sum(F.when(F.col("_value") < F.col("_before"), 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"))


def _split(path: str) -> tuple[str, str]:
    folder, _, name = path.rpartition("/")
    return folder or ".", name


def read_uint64(spark: SparkSession, path: str) -> DataFrame:
    """A raw file of native-endian unsigned 64-bit integers, as DECIMAL(20,0) column ``v`` and their
    places in the file, ``at``; each task reads chunks of it by their ranges."""
    size = Store(spark).size(path)
    if size % 8:
        raise ValueError(f"{path} has {size} bytes, no multiple of 8")
    chunks = spark.range(0, -(-size // CHUNK), 1, max(1, min(-(-size // CHUNK), 8 * spark.sparkContext.defaultParallelism)))
    folder, name = _split(path)

    def run(batches):
        store, at = arrow_store(folder)
        with store.open_input_file(f"{at}/{name}") as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    raw = file.read_at(min(CHUNK, size - k * CHUNK), k * CHUNK)
                    values, first = np.frombuffer(raw, "=u8"), k * CHUNK // 8
                    columns = [pa.array(values, pa.uint64()).cast(pa.decimal128(20, 0)), pa.array(np.arange(first, first + len(values)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["v", "at"])

    return chunks.mapInArrow(run, "v decimal(20,0), at long")


def write_uint64(df: DataFrame, column: str, path: str) -> int:
    """Write a column to one raw file, in the order of the partitions; the number written.

    Tasks write a raw file for each partition beside the target; the JVM then joins them.
    """
    folder = f"{path}.parts"
    store = Store(df.sparkSession)
    store.delete(folder)

    def run(batches):
        context = TaskContext.get()
        name, n = f"{context.partitionId():06d}-{context.taskAttemptId():x}", 0
        system, at = arrow_store(folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{name}") as out:
            for batch in batches:
                values = batch.column(0).cast(pa.uint64()).to_numpy(zero_copy_only=False)
                out.write(values.astype("=u8").tobytes())
                n += len(values)
        if n:
            yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    parts = df.select(F.col(column).cast("decimal(20,0)").alias("v")).mapInArrow(run, "name string, n long")
    written = sorted(tuple(r) for r in parts.collect())  # one row a partition
    store.concatenate([f"{folder}/{name}" for name, _ in written], path)
    store.delete(folder)
    return sum(n for _, n in written)


def sort_file(spark: SparkSession, source: str, target: str) -> int:
    """Sort a raw file of unsigned 64-bit integers into another; an empty file gives an empty one."""
    return write_uint64(sort_ascending(read_uint64(spark, source).select("v"), "v"), "v", target)
