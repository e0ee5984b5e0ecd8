"""Keyed indexes: tables of (key columns, tid), range-partitioned and sorted where they are kept.

Defined results: a null key is a key like others (found, erased and counted as equal to null);
entries may repeat a key, and a key with a tuple id; absent keys erase nothing; probes are each
answered, repeats included; empty indexes and empty probes give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.sorting import ranked_within


@dataclass(frozen=True)
class KeyIndex:
    """Keys may have any ordered type, structs and several columns included."""

    entries: DataFrame
    keys: tuple[str, ...] = ("k",)
    tid: str = "tid"

    def _named(self, df: DataFrame, prefix: str, *more: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in self.keys], *more)

    def _same(self, prefix: str) -> Column:
        return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in self.keys])

    def insert(self, entries: DataFrame) -> KeyIndex:
        """Add entries; keys that are there already get another entry."""
        return KeyIndex(self.entries.unionByName(entries.select(*self.keys, self.tid)), self.keys, self.tid)

    def lookup(self, probes: DataFrame) -> DataFrame:
        """For each probe: ``found`` and one tuple id, the least of the key's, or 0. Only entries
        that are asked for are aggregated."""
        asked = self._named(probes, "_p_").distinct()
        hits = self.entries.join(asked, self._same("_p_"), "left_semi")
        one = hits.groupBy(*self.keys).agg(F.min(self.tid).alias("_tid"), F.lit(True).alias("_hit"))
        one = self._named(one, "_e_", F.col("_tid"), F.col("_hit"))
        joined = probes.select(*self.keys).join(one, self._same("_e_"), "left")
        return joined.select(*self.keys, F.coalesce("_hit", F.lit(False)).alias("found"), F.coalesce("_tid", F.lit(0)).alias(self.tid))

    def find(self, *key: object) -> tuple[bool, int]:
        """Whether one key has an entry, and its least tuple id or 0; a filter that saved indexes
        answer from the files and row groups whose bounds hold the key."""
        wanted = reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, key, strict=True)])
        found = self.entries.filter(wanted).agg(F.count(F.lit(1)), F.min(self.tid)).first()
        return found[0] > 0, found[1] or 0

    def erase(self, keys: DataFrame) -> KeyIndex:
        """Take out one entry (the least tuple id) for each time a key is named."""
        times = self._named(keys.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_times")), "_t_", F.col("_times"))
        hit = self.entries.join(times, self._same("_t_")).select(*self.keys, self.tid, "_times")
        left = ranked_within(hit, list(self.keys), self.tid, "_rank").filter("_rank > _times")
        rest = self.entries.join(times, self._same("_t_"), "left_anti")
        return KeyIndex(rest.select(*self.keys, self.tid).unionByName(left.select(*self.keys, self.tid)), self.keys, self.tid)

    def erase_one(self, *key: object) -> tuple[KeyIndex, bool]:
        """The index without one entry of a key, and whether there was one."""
        found, _ = self.find(*key)
        schema = T.StructType([T.StructField(k, self.entries.schema[k].dataType) for k in self.keys])
        return (self.erase(self.entries.sparkSession.createDataFrame([key], schema)) if found else self), found

    def erased(self, keys: DataFrame) -> DataFrame:
        """For each named key whether it has an entry."""
        return self.lookup(keys.select(*self.keys)).select(*self.keys, "found")

    def size(self) -> DataFrame:
        """One row, ``n``: the number of entries."""
        return self.entries.agg(F.count(F.lit(1)).alias("n"))

    def save(self, path: str) -> KeyIndex:
        """Write the entries in key order, so that lookups by range skip files and row groups."""
        self.entries.repartitionByRange(*self.keys, self.tid).sortWithinPartitions(*self.keys, self.tid).write.mode("overwrite").parquet(path)
        return KeyIndex(self.entries.sparkSession.read.parquet(path), self.keys, self.tid)

    @staticmethod
    def load(spark: SparkSession, path: str, keys: tuple[str, ...] = ("k",), tid: str = "tid") -> KeyIndex:
        return KeyIndex(spark.read.parquet(path), keys, tid)
