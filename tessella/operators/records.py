"""Record operations by tuple id, as pure transformations of snapshots.

Every function takes DataFrames with a ``_tid`` column (or the key named) and returns one; the
versioned tables of :mod:`tessella.sources.database` are built from them.

Defined results: a null id names nothing (it isn't found, updated or removed), and records whose
key is null are never touched; null values are values like others; repeated asked ids are answered
each; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import RepeatedId
from tessella.operators.sorting import numbered

TID = "_tid"


def with_tids(rows: DataFrame, start: int) -> DataFrame:
    """Rows with new tuple ids from ``start`` on, without gaps. As a packed id, tuple n is on page
    n div 65,536 (see :func:`tessella.functions.identifiers.split_tid`). The rows are read once."""
    return numbered(rows, TID, start)


def insert(current: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot with the rows appended."""
    return current.unionByName(rows)


def lookup(current: DataFrame, tids: DataFrame, key: str = TID) -> DataFrame:
    """For each asked id (kept as asked, repeats included) ``found`` and the record's columns."""
    marked = current.withColumn("_found", F.lit(True))
    joined = tids.join(marked, key, "left")
    return joined.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def refuse_repeats(changes: DataFrame, key: str = TID) -> None:
    """``RepeatedId`` if an id (but null) is named more than once; one aggregation."""
    again = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if again:
        raise RepeatedId(f"changes name {', '.join(str(r[0]) for r in again)} more than once")


def update(current: DataFrame, changes: DataFrame, key: str = TID) -> DataFrame:
    """Records whose id is in ``changes`` take its columns; nothing is added. An id that is named
    more than once is refused (this runs ``changes`` once)."""
    refuse_repeats(changes, key)
    return updated(current, changes, key)


def updated(current: DataFrame, changes: DataFrame, key: str = TID) -> DataFrame:
    """:func:`update` for changes whose ids are known to differ."""
    new = [c for c in changes.columns if c != key]
    renamed = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_changed"))
    joined = current.join(renamed, key, "left")
    return joined.select(*[F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in current.columns])


def remove(current: DataFrame, tids: DataFrame, key: str = TID) -> DataFrame:
    """Records whose id isn't asked to go."""
    return current.join(tids.select(key), key, "left_anti")


def outcome(current: DataFrame, tids: DataFrame, name: str, key: str = TID) -> DataFrame:
    """For each asked id whether it exists, as the result of an update or a removal."""
    return lookup(current.select(key), tids.select(key), key).select(key, F.col("found").alias(name))
