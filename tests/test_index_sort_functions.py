import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import identifiers
from tessella.operators import sorting
from tessella.operators.frame import Frame
from tessella.operators.index import KeyIndex
from tessella.operators.relational import hash_join, select_equal
from tessella.streaming import continuous

N = 3000


@pytest.mark.parametrize("key", ["id", "lpad(cast(id as string), 20, '0')", "struct(cast(id div 3 as int) as a, cast(3 - id % 3 as int) as b)"])
def test_insert_lookup_erase_every_seventh(spark, key):
    entries = spark.range(N).select(F.expr(key).alias("k"), (F.col("id") * F.col("id")).alias("tid"))
    index = KeyIndex(entries.limit(0)).insert(entries)
    assert index.size().first().n == N
    assert index.lookup(entries.select("k")).join(entries.withColumnRenamed("tid", "t"), "k").filter("not found or t <> tid").count() == 0
    seventh = spark.range(N).filter("id % 7 = 0").select(F.expr(key).alias("k"))
    left = index.erase(seventh)
    assert left.size().first().n == N - (N + 6) // 7
    assert left.lookup(seventh).filter("found or tid <> 0").count() == 0
    assert left.erase(entries.select("k")).size().first().n == 0


def test_repeated_keys_and_absent_ones(spark):
    index = KeyIndex(spark.createDataFrame([(0, 5)], "k long, tid long"))
    assert index.erased(spark.createDataFrame([(1,)], "k long")).first().found is False
    assert index.erase(spark.createDataFrame([(-1,)], "k long")).size().first().n == 1
    twice = index.insert(spark.createDataFrame([(0, 3), (0, 9)], "k long, tid long"))
    assert [r.tid for r in twice.lookup(spark.createDataFrame([(0,)], "k long")).collect()] == [3]
    once = twice.erase(spark.createDataFrame([(0,)], "k long"))
    assert sorted(r.tid for r in once.entries.collect()) == [5, 9]
    assert KeyIndex(index.entries.limit(0)).lookup(spark.createDataFrame([(0,)], "k long")).first().found is False


def test_null_keys_are_keys(spark):
    index = KeyIndex(spark.createDataFrame([(None, 1), (None, 2), (3, None), (3, 7)], "k long, tid long"))
    probes = spark.createDataFrame([(None,), (3,), (4,), (None,)], "k long")
    found = sorted(((str(r.k), r.found, r.tid) for r in index.lookup(probes).collect()))
    assert found == [("3", True, 7), ("4", False, 0), ("None", True, 1), ("None", True, 1)]
    assert index.find(None) == (True, 1) and index.find(4) == (False, 0)
    assert sorted((str(r.k), str(r.tid)) for r in index.erase(probes.limit(2)).entries.collect()) == [("3", "7"), ("None", "2")]
    fewer, was = index.erase_one(None)
    assert was and fewer.find(None) == (True, 2)
    same, was = index.erase_one(99)
    assert not was and same is index
    assert index.lookup(probes.limit(0)).count() == 0


def test_a_hot_key_is_erased_by_its_least_ids(spark):
    index = KeyIndex(spark.range(4000).selectExpr("if(id % 4 = 0, id, 7) as k", "id as tid").repartition(5))
    left = index.erase(spark.createDataFrame([(7,)] * 5 + [(8,), (9,)], "k long"))
    assert left.size().first().n == 4000 - 6
    assert sorted(r.tid for r in index.entries.join(left.entries, ["k", "tid"], "left_anti").collect()) == [1, 2, 3, 5, 6, 8]


def test_saved_index_is_in_key_order(spark, tmp_path):
    entries = spark.range(1000).select((999 - F.col("id")).alias("k"), F.col("id").alias("tid"))
    index = KeyIndex(entries).save(str(tmp_path / "i"))
    for part in index.entries.rdd.glom().collect():
        keys = [r.k for r in part]
        assert keys == sorted(keys)


def test_ranks_and_violations(spark):
    rows = spark.createDataFrame([(int(v),) for v in np.random.default_rng(1).integers(0, 50, 500)], "v long").repartition(7)
    placed = sorting.ranked(rows, "v")
    found = sorted((r.rn, r.v) for r in placed.collect())
    assert [r for r, _ in found] == list(range(1, 501))
    assert [v for _, v in found] == sorted(v for _, v in found)
    assert sorting.order_violations(placed, "v").first().violations == 0
    wrong = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 0)], "rn long, v long")
    assert sorting.order_violations(wrong, "v").first().violations == 2
    assert sorting.order_violations(wrong.limit(0), "v").first().violations == 0


def test_ranks_with_nulls_and_within_keys(spark):
    rows = spark.createDataFrame([(None,), (2,), (1,), (None,), (1,)], "v long").repartition(3)
    found = sorted((r.rn, r.v) for r in sorting.ranked(rows, "v").collect())
    assert [v for _, v in found] == [None, None, 1, 1, 2] and [n for n, _ in found] == [1, 2, 3, 4, 5]
    assert sorting.order_violations(sorting.ranked(rows, "v"), "v").first().violations == 0
    assert sorting.ranked(rows.limit(0), "v").count() == 0
    keyed = spark.range(500).selectExpr("if(id < 400, null, id % 3) as k", "id as v").repartition(7)
    placed = sorting.ranked_within(keyed, ["k"], "v", "at").collect()
    for key in (None, 0, 1, 2):
        own = sorted((r.at, r.v) for r in placed if r.k == key)
        assert [a for a, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)
    assert len(placed) == 500
    numbers = sorted(r.n for r in sorting.numbered(keyed, "n", 10).collect())
    assert numbers == list(range(10, 510))


def test_sort_file_of_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sorting, "CHUNK", 800)
    values = np.random.default_rng(2).integers(0, 2**64 - 1, 5001, dtype=np.uint64)
    values.tofile(tmp_path / "in")
    assert sorting.sort_file(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 5001
    assert (np.fromfile(tmp_path / "out", np.uint64) == np.sort(values)).all()
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")) == ["in", "out"]
    places = sorted((r["at"], int(r.v)) for r in sorting.read_uint64(spark, str(tmp_path / "out")).collect())
    assert [v for _, v in places] == np.sort(values).tolist() and [a for a, _ in places] == list(range(5001))
    (tmp_path / "odd").write_bytes(b"123")
    with pytest.raises(ValueError, match="multiple of 8"):
        sorting.read_uint64(spark, str(tmp_path / "odd"))


def test_sort_file_of_unsigned_values(spark, tmp_path):
    values = np.array([2**64 - 1, 0, 2**63, 5, 5, 2**63 - 1], np.uint64)
    values.tofile(tmp_path / "in")
    assert sorting.sort_file(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 6
    assert (np.fromfile(tmp_path / "out", np.uint64) == np.sort(values)).all()
    (tmp_path / "none").touch()
    assert sorting.sort_file(spark, str(tmp_path / "none"), str(tmp_path / "out")) == 0
    assert (tmp_path / "out").stat().st_size == 0


def _signed(value):
    return value - 2**64 if value >= 2**63 else value


@pytest.mark.parametrize(
    ("merge", "split", "pairs"),
    [
        (identifiers.merge_tid, identifiers.split_tid, [((3, 1256), (3, 1256)), ((0x000FFFFFFFFFFFFF, 0xFFFFF), (0x0000FFFFFFFFFFFF, 0xFFFF))]),
        (identifiers.merge_page_id, identifiers.split_page_id, [((3, 1256), (3, 1256)), ((0xFFFFF, 0x000FFFFFFFFFFFFF), (0xFFFF, 0x0000FFFFFFFFFFFF))]),
    ],
)
def test_identifiers(spark, merge, split, pairs):
    for given, wanted in pairs:
        packed = spark.createDataFrame([given], "a long, b long").select(merge(F.col("a"), F.col("b")).alias("x"))
        assert tuple(packed.select(*split(F.col("x"))).first()) == wanted
    back = spark.createDataFrame([(_signed(0x000500000000005F),)], "x long")
    assert back.select(merge(*split(F.col("x")))).first()[0] == 0x000500000000005F


def test_pad_char(spark):
    rows = spark.createDataFrame([("ab",), ("abcdef",), ("",)], "s string")
    assert [r[0] for r in rows.select(identifiers.pad_char(F.col("s"), 4)).collect()] == ["ab  ", "abcd", "    "]


def test_stream_filter_and_static_join(spark, tmp_path):
    facts = spark.createDataFrame([(k, k % 3) for k in range(30)], "id long, ref int")
    facts.write.parquet(str(tmp_path / "in"))
    names = Frame.of(spark.createDataFrame([(0, "zero"), (1, "one")], "ref int, name string"))
    joined = hash_join(continuous.stream(spark, str(tmp_path / "in"), facts.schema), names, "ref", "ref")
    query = continuous.write_stream(select_equal(joined, "name", "one"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [k for k in range(30) if k % 3 == 1]


def test_stored_tables_can_be_released(spark):
    from tessella.storage import release, stored

    table = stored(spark.range(5).toDF("x"), "five")
    assert table.count() == 5
    path = table.inputFiles()[0]
    assert release(spark) >= 1
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()
