"""A database: a folder with a catalog and, for each relation, versioned Parquet parts.

A change writes new parts and then publishes the next version of the table's manifest, so readers
see the snapshot before or after it, and a crash at any step leaves the one before. Versions are
published only if their number is free: of two writers the later one starts anew from the other's
snapshot. Updates and removals rewrite only the parts that hold an id they name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import Conflict, EngineError
from tessella.operators import records
from tessella.operators.frame import Frame
from tessella.operators.index import KeyIndex
from tessella.operators.records import TID
from tessella.sources import ddl
from tessella.sources.schema import Relation, Schema
from tessella.storage import Store, Versions, stored

CATALOG = "catalog"
#: How often a change starts anew after other writers' changes.
ATTEMPTS = 10
#: Bytes of values, measured, that a join by ids may broadcast; larger sides are shuffled.
BROADCAST_BYTES = 8 << 20
#: Bytes of an id in a row of its own.
ID_BYTES = 16
Result = TypeVar("Result")


def _retried(change: Callable[[], Result]) -> Result:
    for _ in range(ATTEMPTS - 1):
        try:
            return change()
        except Conflict:
            continue
    return change()


def _measured(rows: DataFrame) -> int:
    """Bytes of a table's values as rows hold them in memory; one pass."""
    texts = [f.name for f in rows.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum((F.coalesce(F.octet_length(rows[x]), F.lit(0)) for x in texts), F.lit(8 + 8 * len(rows.columns)))
    return rows.agg(F.sum(width.cast("long"))).first()[0] or 0


def _sized(rows: DataFrame, size: int) -> DataFrame:
    """One side of a join by ids; beyond BROADCAST_BYTES it is sorted and merged. Spark's own
    estimate is the size of the compressed files, a small part of what dense ids take on the driver."""
    return rows.hint("merge") if size > BROADCAST_BYTES else rows


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark)
        self._catalog = Versions(self.store, self.root, CATALOG)
        self._load()

    def _load(self) -> None:
        self._version, text = self._catalog.latest()
        self.schema = Schema() if text is None else Schema.from_json(text)

    def _publish(self, schema: Schema) -> None:
        self._catalog.publish(self._version + 1, schema.to_json())
        self._version, self.schema = self._version + 1, schema

    def add_relations(self, script: str) -> list[str]:
        """Declare the relations of a script; an error leaves the catalog as it was. Names that
        exist are skipped and returned."""
        parsed = ddl.parse(script)

        def change() -> list[str]:
            self._load()
            schema = Schema.from_json(self.schema.to_json())
            skipped = schema.merge(parsed)
            self._publish(schema)
            return skipped

        return _retried(change)

    def add_relations_from_file(self, path: str) -> list[str]:
        return self.add_relations(self.store.read(path))

    def wipe(self) -> None:
        """Delete the tables and indexes, then the catalog's relations; only folders that have a
        catalog are touched. After a crash on the way, relations may be empty; wipe again."""
        if not self._catalog.numbers():
            raise EngineError(f"{self.root} holds no catalog; nothing was deleted")
        self._load()
        segments = [s for r in self.schema.relations for s in (r.segment, *(i.segment for i in r.indices))]
        for segment in segments:
            self.store.delete(f"{self.root}/{segment}")
        self._publish(Schema())

    def table(self, name_or_segment: str | int) -> Table:
        find = self.schema.relation if isinstance(name_or_segment, str) else self.schema.relation_of_segment
        relation = find(name_or_segment)
        return Table(self, relation, f"{self.root}/{relation.segment}")

    def scan(self, name_or_segment: str | int) -> Frame:
        """All records of a relation, without their ids; none if nothing was ever written."""
        table = self.table(name_or_segment)
        return Frame.of(table.read().drop(TID))

    def listing(self) -> DataFrame:
        """The catalog as rows: one for each attribute."""
        kind = "relation string, segment int, position int, attribute string, type string, length int, in_key boolean"
        rows = [
            (r.name, r.segment, k, a.name, a.type, a.length, k in r.primary_key)
            for r in self.schema.relations
            for k, a in enumerate(r.attributes)
        ]
        return self.spark.createDataFrame(rows, kind)

    def index_path(self, relation: str, attribute: str) -> str:
        return f"{self.root}/{self.schema.index_segment(relation, attribute)}"

    def build_index(self, relation: str, attribute: str) -> KeyIndex:
        """Build the declared index of an attribute from the table's present records."""
        entries = self.table(relation).read().select(F.col(attribute).alias("k"), F.col(TID).alias("tid"))
        return KeyIndex(entries).save(self.index_path(relation, attribute))

    def index(self, relation: str, attribute: str) -> KeyIndex:
        return KeyIndex.load(self.spark, self.index_path(relation, attribute))


class Table:
    """Records by tuple id; ids are dense within an insertion and never used again.

    Null values are kept, whatever NOT NULL declares; null ids name no record.
    """

    def __init__(self, database: Database, relation: Relation, path: str):
        self.database, self.relation, self.path = database, relation, path
        self.spark, self.store = database.spark, database.store
        self.versions = Versions(self.store, path, "manifest")
        typed = [T.StructField(f.name, f.dataType, True, f.metadata) for f in relation.struct()]
        self.kind = T.StructType([T.StructField(TID, T.LongType()), *typed])

    def _manifest(self) -> tuple[int, dict]:
        number, text = self.versions.latest()
        return number, {"next": 0, "parts": []} if text is None else json.loads(text)

    def _commit(self, number: int, manifest: dict, written: str | None) -> None:
        """Publish the version after ``number``; files written for it go if another writer was first."""
        try:
            self.versions.publish(number + 1, json.dumps(manifest))
        except Conflict:
            if written:
                self.store.delete(f"{self.path}/{written}")
            raise

    def _load(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.kind)
        return self.spark.read.schema(self.kind).parquet(*[f"{self.path}/{p['name']}" for p in parts])

    def read(self) -> DataFrame:
        """The present snapshot, with ``_tid``."""
        return self._load(self._manifest()[1]["parts"])

    def insert(self, rows: DataFrame) -> DataFrame:
        """Append rows (types are cast to the declared ones) and return them with their ids."""
        typed = stored(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.kind.fields[1:]]), "insert")

        def change() -> DataFrame:
            number, manifest = self._manifest()
            name = f"part-{uuid.uuid4().hex}"
            first = manifest["next"]
            records.with_tids(typed, first).select(*self.kind.names).write.parquet(f"{self.path}/{name}")
            n = self._load([{"name": name}]).count()
            if not n:
                self.store.delete(f"{self.path}/{name}")
                return self._load([])
            part = {"name": name, "first": first, "last": first + n - 1}
            self._commit(number, {"next": first + n, "parts": [*manifest["parts"], part]}, name)
            return self._load([part])

        return _retried(change)

    def insert_one(self, *values: object) -> int:
        """Append one record; its tuple id."""
        row = self.spark.createDataFrame([values], T.StructType(self.kind.fields[1:]))
        return self.insert(row).first()[TID]

    def lookup(self, tids: DataFrame) -> DataFrame:
        return records.lookup(self.read(), tids)

    def lookup_one(self, tid: int) -> Row | None:
        """The record of an id, from the parts that may hold it; None if there is none."""
        parts = [p for p in self._manifest()[1]["parts"] if p["first"] <= tid <= p["last"]]
        return self._load(parts).filter(F.col(TID) == tid).drop(TID).first()

    def update(self, changes: DataFrame) -> DataFrame:
        """Change records by id; (``_tid``, ``updated``) tells which existed. An id named more than
        once is refused, and nothing changes."""
        asked = stored(changes, "changes")
        records.refuse_repeats(asked)
        return self._rewrite(asked, "updated", records.updated)

    def update_one(self, tid: int, *values: object) -> bool:
        """Replace a record; whether there was one."""
        return self.update(self.spark.createDataFrame([(tid, *values)], self.kind)).first().updated

    def remove(self, tids: DataFrame) -> DataFrame:
        """Remove records by id; (``_tid``, ``removed``) tells which existed."""
        asked = stored(tids.select(TID), "removals")
        return self._rewrite(asked, "removed", records.remove)

    def remove_one(self, tid: int) -> bool:
        """Remove a record; whether there was one."""
        return self.remove(self.spark.createDataFrame([(tid,)], f"{TID} long")).first().removed

    def _rewrite(self, asked: DataFrame, name: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        sized = _sized(asked, _measured(asked))

        def attempt() -> DataFrame:
            number, manifest = self._manifest()
            now = manifest["parts"]
            ids = sum(p["last"] - p["first"] + 1 for p in now)  # at most
            result = stored(records.outcome(_sized(self._load(now), ids * ID_BYTES), asked, name), "outcome")
            touched = self._touched(now, asked)
            if touched:
                folder = self._rewritten(touched, lambda before: change(before, sized))
                fresh = [{**p, "name": f"{folder}/p={k}"} for k, p in enumerate(touched)]
                fresh = [p for p in fresh if self.store.exists(f"{self.path}/{p['name']}")]
                kept = [p for p in now if p not in touched]
                self._commit(number, {**manifest, "parts": [*kept, *fresh]}, folder)
            return result

        return _retried(attempt)

    def _touched(self, parts: list[dict], asked: DataFrame) -> list[dict]:
        """The parts whose range of ids holds one that is asked for."""
        if not parts:
            return []
        ranges = self.spark.createDataFrame([(k, p["first"], p["last"]) for k, p in enumerate(parts)], "part int, first long, last long")
        inside = asked[TID].between(F.col("first"), F.col("last"))
        found = asked.join(F.broadcast(ranges), inside).select("part").distinct().collect()  # a row a part at most
        return [parts[k] for k in sorted(r.part for r in found)]

    def _rewritten(self, touched: list[dict], change: Callable[[DataFrame], DataFrame]) -> str:
        """Write the changed records of the parts, each part's to a folder of its own; their folder."""
        folder = f"part-{uuid.uuid4().hex}"
        names = F.create_map(*[F.lit(x) for k, p in enumerate(touched) for x in (p["name"], k)])
        own = F.regexp_extract(F.col("_metadata.file_path"), r"/(part-[0-9a-f]{32}(?:/p(?:=|%3D)[0-9]+)?)/[^/]*$", 1)
        now = self._load(touched).withColumn("p", F.element_at(names, F.replace(own, F.lit("%3D"), F.lit("="))))
        changed = change(now)
        changed.select(*self.kind.names, "p").write.partitionBy("p").parquet(f"{self.path}/{folder}")
        return folder

    def vacuum(self) -> int:
        """Delete the parts that none of the kept versions names; how many. Only for tables that no
        other writer is changing."""
        named = {p["name"].split("/")[0] for n in self.versions.numbers() for p in json.loads(self.store.read(self.versions.path(n)))["parts"]}
        return sum(self.store.delete(f"{self.path}/{x}") for x in self.store.names(self.path) if x.startswith("part-") and x not in named)

    def insert_rows(self, rows: Sequence[tuple]) -> DataFrame:
        """Append rows that the client holds."""
        return self.insert(self.spark.createDataFrame(list(rows), T.StructType(self.kind.fields[1:])))
