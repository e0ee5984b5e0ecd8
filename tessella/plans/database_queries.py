"""Registered queries of databases, catalogs, scripts, files and cursors, with their DuckDB equivalents.

Each query makes a database of its own in the shared folder. Answers that don't depend on the
tables have a list of values as their equivalent.
"""

from __future__ import annotations

import io
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import EngineError, SchemaParserError
from tessella.functions import identifiers
from tessella.operators import relational, sorting, text_sink
from tessella.operators.frame import Cursor, Frame
from tessella.operators.index import KeyIndex
from tessella.operators.records import TID
from tessella.sources import ddl
from tessella.sources.database import Database
from tessella.sources.schema import Schema
from tessella.storage import Store, remember, shared_dir

SHOP = """CREATE TABLE orders (
  o_orderkey integer,
  o_custkey integer NOT NULL,
  o_orderstatus char( 1 ),
  primary key (o_orderkey, o_custkey)
);
create table customer (c_custkey integer, primary key (c_custkey), c_name char(25), c_nationkey integer, c_mktsegment Char(10));
create table nation ( n_nationkey integer, n_name char(25), n_regionkey integer );
"""
MORE = "create table customer (other integer); create table region (r_regionkey integer, r_name char(25), primary key (r_regionkey));"
WIDE = 10_000


def _folder(spark: SparkSession) -> str:
    return remember(f"{shared_dir(spark)}/database-{uuid.uuid4().hex}")


def _database(spark: SparkSession) -> Database:
    database = Database(spark, _folder(spark))
    database.add_relations(SHOP)
    return database


def _filled(spark: SparkSession, sf_dir: str, name: str) -> tuple[Database, DataFrame]:
    """A database that holds one of the driver's tables, and the inserted records."""
    database = _database(spark)
    table = database.table(name)
    return database, table.insert(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*table.kind.names[1:]))


def scan_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, opened anew and scanned by the relation's name."""
    database, _ = _filled(spark, sf_dir, "customer")
    return Database(spark, database.root).scan("customer").to_df()


def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, _ = _filled(spark, sf_dir, "orders")
    return Database(spark, database.root).scan(1).to_df()


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, first = _filled(spark, sf_dir, "nation")
    database.table("nation").insert(first.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return database.table("nation").read().drop(TID)


def dml_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the table's ids, and as many absent ones."""
    database, inserted = _filled(spark, sf_dir, "orders")
    asked = inserted.select(TID).union(inserted.select(-1 - F.col(TID)))
    found = database.table("orders").lookup(asked)
    return found.select("found", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), F.coalesce("o_orderstatus", F.lit("")).alias("st"))


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, inserted = _filled(spark, sf_dir, "customer")
    changes = inserted.filter("c_custkey % 10 = 0").select(TID, F.lit("UPDATED").alias("c_mktsegment"))
    database.table("customer").update(changes)
    return database.table("customer").read().drop(TID)


def dml_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    database, inserted = _filled(spark, sf_dir, "orders")
    database.table("orders").remove(inserted.filter("o_orderstatus = 'F'").select(TID))
    return database.table("orders").read().drop(TID)


def dml_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each asked id existed: those removed before don't, others do."""
    database, inserted = _filled(spark, sf_dir, "orders")
    table = database.table("orders")
    removed = table.remove(inserted.filter("o_orderkey % 5 = 0").select(TID)).select(F.lit("remove").alias("kind"), F.col("removed").alias("done"))
    updated = table.update(inserted.select(TID, F.lit("X").alias("o_orderstatus"))).select(F.lit("update").alias("kind"), F.col("updated").alias("done"))
    again = table.remove(inserted.filter("o_orderkey % 2 = 0").select(TID)).select(F.lit("again").alias("kind"), F.col("removed").alias("done"))
    return removed.union(updated).union(again).groupBy("kind", "done").agg(F.count(F.lit(1)).alias("n"))


def dml_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms for one id or one key."""
    table = _database(spark).table("nation")
    tids = [table.insert_one(k, f"n{k}", k % 2) for k in (5, 6)]
    steps = [
        ("insert", str(tids)),
        ("lookup", str(tuple(table.lookup_one(tids[1])))),
        ("lookup absent", str(table.lookup_one(99))),
        ("update", str(table.update_one(tids[0], 7, "seven", 1))),
        ("update absent", str(table.update_one(99, 7, "seven", 1))),
        ("remove", str(table.remove_one(tids[1]))),
        ("remove again", str(table.remove_one(tids[1]))),
    ]
    index = KeyIndex(table.read().select(F.col("n_nationkey").alias("k"), F.col(TID).alias("tid")))
    fewer, erased = index.erase_one(7)
    steps += [("find", str(index.find(7))), ("find absent", str(index.find(8))), ("erase", str(erased)), ("erase again", str(fewer.erase_one(7)[1]))]
    return spark.createDataFrame(steps, "step string, answer string")


def tid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the packed tuple ids, and how many records each has."""
    _, inserted = _filled(spark, sf_dir, "orders")
    page, slot = identifiers.split_tid(F.col(TID))
    return inserted.select(page.alias("page"), slot.alias("slot")).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last_slot"))


def idx_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that the primary key declares, built, loaded, and joined to the records it points to."""
    database, inserted = _filled(spark, sf_dir, "orders")
    database.build_index("orders", "o_orderkey")
    entries = Database(spark, database.root).index("orders", "o_orderkey").entries
    return entries.join(inserted, F.col("tid") == F.col(TID)).select("k", "o_orderkey", "o_custkey")


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuple by tuple: the registers' names, types and values."""
    reading = Cursor(relational.scan(spark, f"{sf_dir}/nation.parquet"))
    reading.open()
    rows = []
    while reading.next():
        registers = reading.output()
        rows += [(registers[0].integer, r.name, r.tag, r.integer, r.string) for r in registers]
    reading.close()
    return spark.createDataFrame(rows, "k int, name string, type string, integer int, string string")


def print_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink's lines, with the header, and a column that is printed twice."""
    out = io.StringIO()
    text_sink.print_text(relational.project_names(relational.scan(spark, f"{sf_dir}/nation.parquet"), ["n_name", "n_nationkey", "n_name"]), out)
    return spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")


def sort_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw file of unsigned 64-bit integers, written, sorted into another and read back with places."""
    folder = _folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sorting.write_uint64(orders.select((F.col("o_custkey") * 1_000_003 + F.col("o_orderkey")).alias("v")), "v", f"{folder}/in")
    sorting.sort_file(spark, f"{folder}/in", f"{folder}/out")
    return sorting.read_uint64(spark, f"{folder}/out").select((F.col("at") + 1).alias("rn"), F.col("v").cast("long").alias("v"))


def ddl_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared relations of a script with their segments, keys and implicit indexes."""
    return _listed(spark, _database(spark).schema)


def ddl_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    Store(spark).create(f"{folder}/shop.sql", SHOP)
    database = Database(spark, f"{folder}/database")
    database.add_relations_from_file(f"{folder}/shop.sql")
    return _listed(spark, database.schema)


def _listed(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [
        (r.name, r.segment, k, a.name, a.type, a.length, a.not_null, k in r.primary_key, next((i.segment for i in r.indices if i.attribute == a.name), 0))
        for r in schema.relations
        for k, a in enumerate(r.attributes)
    ]
    kind = "relation string, segment int, position int, attribute string, type string, length int, not_null boolean, in_key boolean, index_segment int"
    return spark.createDataFrame(rows, kind)


def ddl_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second script: a name that exists is skipped, others get the lowest free segments."""
    database = _database(spark)
    skipped = database.add_relations(MORE)
    rows = [(r.name, r.segment, len(r.attributes), r.name in skipped) for r in database.schema.relations]
    return spark.createDataFrame(rows, "relation string, segment int, attributes int, skipped boolean")


# Scripts, and the line of the error (0: accepted).
GRAMMAR = (
    ("create table t (a integer,);", 0),
    ("create table t ();", 0),
    ("create table t (a integer)", 0),
    ("CREATE table 9t (A_1 Char(3) not NULL);", 0),
    ("", 0),
    ("create table t (a integer", 1),
    ("create table t (a\n integr);", 2),
    ("create table t (a integer primary key);", 1),
    ("create table t (\n\nprimary key (a), a integer);", 3),
    ("create table t (A integer, primary key (a));", 1),
    ("create table table (a integer);", 1),
    ("create table t (a numeric(3, 2));", 1),
    ("create table t (a-b integer);", 1),
    ("drop table t;", 1),
    ("create table t (a char(x));", 1),
)


def ddl_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line_of_error(script: str) -> int:
        try:
            ddl.parse(script)
        except SchemaParserError as error:
            return error.line
        return 0

    return spark.createDataFrame([(k, line_of_error(script)) for k, (script, _) in enumerate(GRAMMAR)], "script int, line int")


def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark).listing()


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in _database(spark).schema.to_text().splitlines()], "line string")


def catalog_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes and segments of relations, segments of indexes, relations of segments, and what
    lookups of other names and ids answer."""
    database = _database(spark)
    schema = database.schema

    def answer(look) -> str:
        try:
            return str(look())
        except EngineError as error:
            return type(error).__name__

    asked = {
        "attributes of customer": lambda: ", ".join(a.name for a in schema.relation("customer").attributes),
        "segment of customer": lambda: schema.relation("customer").segment,
        "segment of the index on o_custkey": lambda: schema.index_segment("orders", "o_custkey"),
        "relation of segment 6": lambda: schema.relation_of_segment(6).name,
        "records of segment 6": lambda: database.table(6).read().count(),
        "relation nothing": lambda: schema.relation("nothing"),
        "relation of segment 99": lambda: schema.relation_of_segment(99),
        "index on c_name": lambda: schema.index_segment("customer", "c_name"),
        "scan of nothing": lambda: database.scan("nothing"),
        "scan of segment 99": lambda: database.scan(99),
    }
    return spark.createDataFrame([(k, answer(look)) for k, look in asked.items()], "asked string, answer string")


def plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operators refuse when the plan is built, and what they don't."""
    nation = relational.scan(spark, f"{sf_dir}/nation.parquet")
    twice = relational.project_names(nation, ["n_name", "n_name", "n_nationkey"])

    def outcome(build) -> str:
        try:
            found = build()
        except EngineError as error:
            return type(error).__name__
        return ", ".join(found.names) if isinstance(found, Frame) else str(found)

    built = {
        "select on an unknown column": lambda: relational.select_equal(nation, "nothing", 1),
        "string constant for an integer": lambda: relational.select_equal(nation, "n_nationkey", "1"),
        "integer constant for a string": lambda: relational.select_equal(nation, "n_name", 1),
        "join of an integer and a string": lambda: relational.hash_join(nation, nation, "n_nationkey", "n_name"),
        "join on an unknown column": lambda: relational.hash_join(nation, nation, "n_nationkey", "nothing"),
        "position beyond the columns": lambda: relational.project_positions(nation, [3]),
        "unknown name": lambda: relational.project_names(nation, ["nothing", "n_name"]),
        "unknown name, not strict": lambda: relational.project_names(nation, ["nothing", "n_name"], strict=False),
        "first column of a repeated name": lambda: twice.first("n_name"),
    }
    return spark.createDataFrame([(k, outcome(build)) for k, build in built.items()], "plan string, outcome string")


def schema_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ddl.parse(SHOP)
    others = {
        "line breaks and blanks": ddl.parse(" ".join(SHOP.replace("( 1 )", "(1)").split())),
        "another name": ddl.parse(SHOP.replace("c_name", "c_nome")),
        "another length": ddl.parse(SHOP.replace("char(25)", "char(24)")),
        "another order": Schema(parsed.relations[::-1]),
        "fewer relations": Schema(parsed.relations[:2]),
        "another key": ddl.parse(SHOP.replace("(o_orderkey, o_custkey)", "(o_orderkey)")),
    }
    return spark.createDataFrame([(k, other == parsed) for k, other in others.items()], "other string, equal boolean")


def schema_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation of many columns, as a database that is opened anew has it."""
    database = Database(spark, _folder(spark))
    columns = ", ".join(f"w_{k} {'integer' if k % 3 else f'char({k + 1})'}" for k in range(WIDE))
    database.add_relations(f"create table wide ({columns}, primary key (w_1));")
    again = Database(spark, database.root)
    if again.schema != database.schema:
        raise EngineError("the catalog that was read differs from the one that was written")
    return again.listing().select("position", "attribute", "type", "length", "in_key")


def wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations and files before and after, and what a folder without a catalog answers."""
    database, _ = _filled(spark, sf_dir, "nation")

    def state(when: str) -> tuple:
        return when, len(Database(spark, database.root).schema.relations), database.store.exists(f"{database.root}/6")

    rows = [state("before")]
    database.wipe()
    rows.append(state("after"))
    try:
        Database(spark, _folder(spark)).wipe()
    except EngineError as error:
        rows.append((type(error).__name__, 0, False))
    return spark.createDataFrame(rows, "state string, relations int, files boolean")


def file_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, path = Store(spark), f"{_folder(spark)}/file"
    rows = [("exists before", store.exists(path))]
    store.create(path, "text")
    rows += [("exists", store.exists(path)), ("reads", store.read(path) == "text"), ("deleted", store.delete(path)), ("exists after", store.exists(path)), ("deleted again", store.delete(path))]
    return spark.createDataFrame(rows, "what string, answer boolean")


def log_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's entries for relations that exist already."""
    seen: list[tuple[str, str]] = []
    handler = logging.Handler()
    handler.emit = lambda record: seen.append((record.levelname, record.getMessage()))
    log = logging.getLogger("tessella.sources.schema")
    database = _database(spark)
    log.addHandler(handler)
    try:
        database.add_relations(MORE)
    finally:
        log.removeHandler(handler)
    return spark.createDataFrame(seen, "level string, message string")


QUERIES = {
    f.__name__: f
    for f in (
        scan_by_name,
        scan_by_id,
        dml_insert,
        dml_lookup,
        dml_update,
        dml_remove,
        dml_results,
        dml_single,
        tid_pages,
        idx_auto,
        cursor,
        print_stream,
        sort_file,
        ddl_string,
        ddl_file,
        ddl_merge,
        ddl_grammar,
        catalog_list,
        catalog_text,
        catalog_lookups,
        plan_errors,
        schema_eq,
        schema_roundtrip,
        wipe,
        file_ops,
        log_skipped,
    )
}


def _values(columns: str, *rows: tuple) -> str:
    def shown(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, row)) + ')' for row in rows)}) t({columns})"


_DECLARED = (
    ("orders", 1, 0, "o_orderkey", "Integer", 0, True, True, 2),
    ("orders", 1, 1, "o_custkey", "Integer", 0, True, True, 3),
    ("orders", 1, 2, "o_orderstatus", "Char", 1, True, False, 0),
    ("customer", 4, 0, "c_custkey", "Integer", 0, True, True, 5),
    ("customer", 4, 1, "c_name", "Char", 25, True, False, 0),
    ("customer", 4, 2, "c_nationkey", "Integer", 0, True, False, 0),
    ("customer", 4, 3, "c_mktsegment", "Char", 10, True, False, 0),
    ("nation", 6, 0, "n_nationkey", "Integer", 0, True, False, 0),
    ("nation", 6, 1, "n_name", "Char", 25, True, False, 0),
    ("nation", 6, 2, "n_regionkey", "Integer", 0, True, False, 0),
)
_DECLARED_NAMES = "relation, segment, position, attribute, type, length, not_null, in_key, index_segment"
_ORDERS = "SELECT CAST(o_orderkey AS INT) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus FROM orders"
_CUSTOMER = "SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, c_nationkey, {segment} AS c_mktsegment FROM customer"

ORACLE_SQL = {
    "scan_by_name": _CUSTOMER.format(segment="c_mktsegment"),
    "scan_by_id": _ORDERS,
    "dml_insert": "SELECT * FROM nation UNION ALL SELECT CAST(n_nationkey + 100 AS INT) AS n_nationkey, n_name, n_regionkey FROM nation",
    "dml_lookup": "SELECT true AS found, CAST(o_orderkey AS INT) AS o_orderkey, o_orderstatus AS st FROM orders UNION ALL SELECT false, -1, '' FROM orders",
    "dml_update": _CUSTOMER.format(segment="CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' ELSE c_mktsegment END"),
    "dml_remove": f"{_ORDERS} WHERE o_orderstatus <> 'F'",
    "dml_results": "SELECT * FROM (SELECT 'remove' AS kind, true AS done, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 "
    "UNION ALL SELECT 'update', o_orderkey % 5 <> 0, count(*) FROM orders GROUP BY ALL "
    "UNION ALL SELECT 'again', o_orderkey % 5 <> 0, count(*) FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)",
    "dml_single": _values(
        "step, answer",
        ("insert", "[0, 1]"),
        ("lookup", "(6, 'n6', 0)"),
        ("lookup absent", "None"),
        ("update", "True"),
        ("update absent", "False"),
        ("remove", "True"),
        ("remove again", "False"),
        ("find", "(True, 0)"),
        ("find absent", "(False, 0)"),
        ("erase", "True"),
        ("erase again", "False"),
    ),
    "tid_pages": "SELECT i // 65536 AS page, count(*) AS n, max(i % 65536) AS last_slot FROM range((SELECT count(*) FROM orders)) t(i) GROUP BY 1",
    "idx_auto": "SELECT CAST(o_orderkey AS INT) AS k, CAST(o_orderkey AS INT) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey FROM orders",
    "cursor": "SELECT n_nationkey AS k, 'n_nationkey' AS name, 'Integer' AS type, n_nationkey AS integer, '' AS string FROM nation "
    "UNION ALL SELECT n_nationkey, 'n_name', 'Char', CAST(-2147483648 AS INT), n_name FROM nation "
    "UNION ALL SELECT n_nationkey, 'n_regionkey', 'Integer', n_regionkey, '' FROM nation",
    "print_stream": "SELECT 'n_name, n_nationkey, n_name' AS line UNION ALL SELECT concat_ws(', ', n_name, CAST(n_nationkey AS VARCHAR), n_name) FROM nation",
    "sort_file": "SELECT row_number() OVER (ORDER BY v) AS rn, v FROM (SELECT o_custkey * 1000003 + o_orderkey AS v FROM orders)",
    "ddl_string": _values(_DECLARED_NAMES, *_DECLARED),
    "ddl_file": _values(_DECLARED_NAMES, *_DECLARED),
    "ddl_merge": _values("relation, segment, attributes, skipped", ("orders", 1, 3, False), ("customer", 4, 4, True), ("nation", 6, 3, False), ("region", 7, 2, False)),
    "ddl_grammar": _values("script, line", *[(k, line) for k, (_, line) in enumerate(GRAMMAR)]),
    "catalog_list": _values("relation, segment, position, attribute, type, length, in_key", *[(*row[:6], row[7]) for row in _DECLARED]),
    "catalog_text": _values(
        "line",
        ("orders (segment 1)",),
        ("  primary key: o_orderkey, o_custkey",),
        ("  o_orderkey Integer not null",),
        ("  o_custkey Integer not null",),
        ("  o_orderstatus Char(1) not null",),
        ("  index on o_orderkey (segment 2)",),
        ("  index on o_custkey (segment 3)",),
        ("customer (segment 4)",),
        ("  primary key: c_custkey",),
        ("  c_custkey Integer not null",),
        ("  c_name Char(25) not null",),
        ("  c_nationkey Integer not null",),
        ("  c_mktsegment Char(10) not null",),
        ("  index on c_custkey (segment 5)",),
        ("nation (segment 6)",),
        ("  primary key: none",),
        ("  n_nationkey Integer not null",),
        ("  n_name Char(25) not null",),
        ("  n_regionkey Integer not null",),
    ),
    "catalog_lookups": _values(
        "asked, answer",
        ("attributes of customer", "c_custkey, c_name, c_nationkey, c_mktsegment"),
        ("segment of customer", "4"),
        ("segment of the index on o_custkey", "3"),
        ("relation of segment 6", "nation"),
        ("records of segment 6", "0"),
        ("relation nothing", "UnknownRelation"),
        ("relation of segment 99", "UnknownRelation"),
        ("index on c_name", "UnknownRelation"),
        ("scan of nothing", "UnknownRelation"),
        ("scan of segment 99", "UnknownRelation"),
    ),
    "plan_errors": _values(
        "plan, outcome",
        ("select on an unknown column", "UnknownColumn"),
        ("string constant for an integer", "TypeMismatch"),
        ("integer constant for a string", "TypeMismatch"),
        ("join of an integer and a string", "TypeMismatch"),
        ("join on an unknown column", "UnknownColumn"),
        ("position beyond the columns", "UnknownColumn"),
        ("unknown name", "UnknownColumn"),
        ("unknown name, not strict", "n_name"),
        ("first column of a repeated name", "0"),
    ),
    "schema_eq": _values(
        "other, equal",
        ("line breaks and blanks", True),
        ("another name", False),
        ("another length", False),
        ("another order", False),
        ("fewer relations", False),
        ("another key", False),
    ),
    "schema_roundtrip": "SELECT CAST(i AS INT) AS position, 'w_' || i AS attribute, CASE WHEN i % 3 = 0 THEN 'Char' ELSE 'Integer' END AS type, "
    f"CAST(CASE WHEN i % 3 = 0 THEN i + 1 ELSE 0 END AS INT) AS length, i = 1 AS in_key FROM range({WIDE}) t(i)",
    "wipe": _values("state, relations, files", ("before", 3, True), ("after", 0, False), ("EngineError", 0, False)),
    "file_ops": _values("what, answer", ("exists before", False), ("exists", True), ("reads", True), ("deleted", True), ("exists after", False), ("deleted again", False)),
    "log_skipped": _values("level, message", ("ERROR", "relation customer exists already and is skipped")),
}
