import random

import pytest
from pyspark.sql import functions as F

from tessella.errors import Conflict, EngineError, RepeatedId, SchemaParserError, UnknownRelation
from tessella.operators import records
from tessella.operators.records import TID
from tessella.sources import ddl
from tessella.sources.database import Database
from tessella.sources.schema import Schema
from tessella.storage import Store, Versions

SCRIPT = """CREATE TABLE lineitem (
  l_orderkey integer,
  l_flag char(1),
  l_partkey integer,
  l_quantity integer,
  l_mode char(10),
  l_comment char(44),
  primary key (l_orderkey, l_flag)
);
create table part ( p_partkey integer, p_name char(55), p_brand char(10), primary key (p_partkey) );
create table region (r_regionkey integer, primary key (r_regionkey), r_name char(25), r_code char(1));
"""


def test_line_breaks_and_blanks_do_not_matter():
    assert ddl.parse(SCRIPT) == ddl.parse(" ".join(SCRIPT.replace("char(10)", "char( 10 )").replace("key (", "key(").split()))


def test_other_name_is_unequal():
    assert ddl.parse(SCRIPT) != ddl.parse(SCRIPT.replace("l_quantity", "l_qantity"))
    assert ddl.parse(SCRIPT) != Schema(ddl.parse(SCRIPT).relations[:2])


def test_segments_after_merging():
    schema = Schema()
    assert schema.merge(ddl.parse(SCRIPT)) == []
    assert [(r.segment, [i.segment for i in r.indices]) for r in schema.relations] == [(1, [2, 3]), (4, [5]), (6, [7])]
    assert schema.merge(ddl.parse(SCRIPT)) == ["lineitem", "part", "region"]
    assert schema.index_segment("lineitem", "l_flag") == 3
    with pytest.raises(UnknownRelation):
        schema.index_segment("lineitem", "l_mode")


def test_round_trip_of_a_wide_schema():
    wide = SCRIPT.replace("l_mode char(10),", "l_mode char(10)," + "".join(f"extra_{k} integer," for k in range(10_000)))
    schema = ddl.parse(wide)
    assert len(schema.relations[0].attributes) == 10_006
    again = Schema.from_json(schema.to_json())
    assert again == schema
    assert again.relations[0].struct()["l_comment"].metadata == {"len": 44}


@pytest.mark.parametrize("script", ["create table t (a integer,);", "create table t ();", "create table t (a integer)", "CREATE table 9t (A_1 Char(3) not NULL);", ""])
def test_accepted(script):
    ddl.parse(script)


@pytest.mark.parametrize(
    ("script", "line"),
    [
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
    ],
)
def test_rejected_with_its_line(script, line):
    with pytest.raises(SchemaParserError) as error:
        ddl.parse(script)
    assert error.value.line == line


def test_names_keep_their_case():
    relation = ddl.parse("create table Tab (Id integer, primary key (Id));").relations[0]
    assert (relation.name, relation.attributes[0].name, relation.primary_key) == ("Tab", "Id", [0])


def test_database_persists_lists_and_wipes(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    with pytest.raises(EngineError):
        db.wipe()
    (tmp_path / "s.sql").write_text(SCRIPT)
    db.add_relations_from_file(str(tmp_path / "s.sql"))
    with pytest.raises(SchemaParserError):
        db.add_relations("create table x (a foo);")
    again = Database(spark, str(tmp_path / "db"))
    assert again.schema == db.schema
    assert again.listing().filter("in_key").count() == 4
    assert "lineitem (segment 1)" in again.schema.to_text()
    assert list(again.scan("part").rows()) == []
    assert again.scan(4).names == ("p_partkey", "p_name", "p_brand")
    for wrong in ("nope", 99):
        with pytest.raises(UnknownRelation):
            again.scan(wrong)
    again.table("region").insert(spark.createDataFrame([(1, "a", "x")], "r_regionkey int, r_name string, r_code string"))
    assert list(again.scan("region").rows()) == [(1, "a", "x")]
    again.wipe()
    assert Database(spark, str(tmp_path / "db")).schema == Schema()
    assert not (tmp_path / "db" / "6").exists()


def test_records_behave_like_a_dict(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.add_relations("create table dbtest ( strentry char(5000), primary key (strentry));")
    table, model, rng = db.table("dbtest"), {}, random.Random(11)
    for step in range(6):
        texts = [f"{step}-{k}" * rng.randrange(1, 9) for k in range(40)]
        for row in table.insert(spark.createDataFrame([(t,) for t in texts], "strentry string")).collect():
            assert row[TID] not in model
            model[row[TID]] = row.strentry
        chosen = rng.sample(sorted(model), 10)
        changes = [(t, f"new {t} {step}") for t in chosen] + [(10**15, "nowhere")]
        done = {r[TID]: r.updated for r in table.update(spark.createDataFrame(changes, f"{TID} long, strentry string")).collect()}
        assert done == {t: t in model for t, _ in changes}
        model |= {t: s for t, s in changes if t in model}
        gone = rng.sample(sorted(model), 5)
        done = {r[TID]: r.removed for r in table.remove(spark.createDataFrame([(t,) for t in [*gone, -5]], f"{TID} long")).collect()}
        assert done == {t: True for t in gone} | {-5: False}
        for t in gone:
            del model[t]
    assert {r[TID]: r.strentry for r in table.read().collect()} == model
    asked = [*rng.sample(sorted(model), 3), 10**15]
    found = {r[TID]: (r.found, r.strentry) for r in table.lookup(spark.createDataFrame([(t,) for t in asked], f"{TID} long")).collect()}
    assert found == {t: (t in model, model.get(t)) for t in asked}
    index = db.build_index("dbtest", "strentry")
    assert index.size().first().n == len(model)
    some = next(iter(model.values()))
    hit = db.index("dbtest", "strentry").lookup(spark.createDataFrame([(some,), ("absent",)], "k string"))
    assert {r.k: r.found for r in hit.collect()} == {some: True, "absent": False}
    table.remove(table.read().select(F.col(TID)))
    assert table.read().count() == 0


@pytest.fixture
def pairs(spark, tmp_path):
    database = Database(spark, str(tmp_path / "db"))
    database.add_relations("create table pairs (a integer, b char(9), primary key (a));")
    table = database.table("pairs")
    table.insert_rows([(k, f"b{k}") for k in range(10)])
    return table


def _records(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.mark.parametrize("step", ["create", "publish", "_rewritten"])
def test_a_crash_on_the_way_keeps_the_snapshot(pairs, spark, monkeypatch, step):
    """Before the manifest's file is there, before it has its name, and while parts are written."""
    before = _records(pairs)

    def crash(*_):
        raise KeyboardInterrupt

    owner = {"create": Store, "publish": Versions, "_rewritten": type(pairs)}[step]
    with monkeypatch.context() as patch:
        patch.setattr(owner, step, crash)
        with pytest.raises(KeyboardInterrupt):
            pairs.update_one(3, 33, "x")
        if step != "_rewritten":
            with pytest.raises(KeyboardInterrupt):
                pairs.insert_one(99, "y")
    again = Database(spark, pairs.database.root).table("pairs")
    assert _records(again) == before
    assert again.insert_one(99, "y") == 10
    assert again.vacuum() >= (step != "_rewritten") and _records(again) == [*before, (10, 99, "y")]


def test_a_name_is_published_once_and_whole(spark, tmp_path):
    store, path = Store(spark), str(tmp_path / "x" / "file")
    store.create(path, "first")
    with pytest.raises(FileExistsError):
        store.create(path, "second")
    assert store.read(path) == "first" and store.names(str(tmp_path / "x")) == ["file"]
    versions = Versions(store, str(tmp_path / "v"), "m")
    assert versions.latest() == (0, None)
    for n in range(1, 30):
        versions.publish(n, str(n))
    with pytest.raises(Conflict):
        versions.publish(29, "other")
    assert versions.latest() == (29, "29") and len(versions.numbers()) == Versions.KEPT


def test_a_writer_between_costs_no_change(pairs, spark, monkeypatch):
    """Another writer publishes just before this one does; both changes stand, with ids of their own."""
    other = Database(spark, pairs.database.root).table("pairs")
    publish, interfered = Versions.publish, []

    def late(versions, number, text):
        if not interfered:
            interfered.append(1)
            interfered.append(other.insert_one(50, "other"))
        publish(versions, number, text)

    monkeypatch.setattr(Versions, "publish", late)
    assert pairs.insert_one(51, "own") == 11 and interfered[1] == 10
    interfered.clear()
    assert pairs.update_one(2, 22, "own")
    assert [r for r in _records(pairs) if r[0] in (2, 10, 11, 12)] == [(2, 22, "own"), (10, 50, "other"), (11, 51, "own"), (12, 50, "other")]


def test_repeated_and_null_ids(pairs, spark):
    before = _records(pairs)
    with pytest.raises(RepeatedId):
        pairs.update(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "_tid long, a int, b string"))
    assert _records(pairs) == before
    done = pairs.update(spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), (4, None, None)], "_tid long, a int, b string"))
    assert sorted(((r[TID], r.updated) for r in done.collect()), key=str) == [(4, True), (None, False), (None, False)]
    assert [r for r in _records(pairs) if r[0] == 4] == [(4, None, None)]
    gone = pairs.remove(spark.createDataFrame([(5,), (5,), (None,)], "_tid long"))
    assert sorted(((r[TID], r.removed) for r in gone.collect()), key=str) == [(5, True), (5, True), (None, False)]
    assert pairs.read().count() == 9 and pairs.lookup_one(5) is None
    asked = pairs.lookup(spark.createDataFrame([(None,), (4,), (4,)], "_tid long")).collect()
    assert sorted((str(r[TID]), r.found) for r in asked) == [("4", True), ("4", True), ("None", False)]
    for nothing in (pairs.update(spark.createDataFrame([], "_tid long, a int, b string")), pairs.remove(spark.createDataFrame([], "_tid long"))):
        assert nothing.count() == 0


def test_only_the_parts_that_hold_an_id_are_rewritten(pairs, spark):
    for k in range(3):
        pairs.insert_rows([(100 * k + j, None) for j in range(5)])
    _, before = pairs._manifest()
    pairs.update(spark.createDataFrame([(0, 1), (24, 2)], "_tid long, a int"))
    _, after = pairs._manifest()
    assert [p for p in before["parts"] if p in after["parts"]] == before["parts"][1:-1]
    assert after["next"] == 25 and [(p["first"], p["last"]) for p in before["parts"]] == sorted((p["first"], p["last"]) for p in after["parts"])
    pairs.remove(spark.createDataFrame([(k,) for k in range(10, 15)], "_tid long"))
    assert len(pairs._manifest()[1]["parts"]) == 3
    assert pairs.insert_rows([]).count() == 0


def test_many_ids_are_not_broadcast(spark, pairs, monkeypatch):
    """Dense ids are small on disk, so that Spark's estimate would have the driver hold all of them."""
    n, plans = 700_000, []
    for name in ("outcome", "updated", "remove"):

        def spied(*args, real=getattr(records, name)):
            result = real(*args)
            plans.append(result._jdf.queryExecution().executedPlan().toString())
            return result

        monkeypatch.setattr(records, name, spied)
    inserted = pairs.insert(spark.range(n).select(F.col("id").cast("int").alias("a"), F.lit("b").alias("b")))
    done = pairs.update(inserted.select(TID, F.lit("x").alias("b")))
    assert done.filter("updated").count() == n == pairs.read().filter("b = 'x'").count()
    gone = pairs.remove(inserted.select(TID).filter("_tid % 8 > 0"))
    assert gone.filter("removed").count() == n * 7 // 8 and pairs.read().count() == n // 8 + 10
    assert len(plans) == 4 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    assert pairs.update_one(3, 33, "x") and "BroadcastHashJoin" in plans[-1]
