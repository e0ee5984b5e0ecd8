"""Registered queries of the relational engine and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import identifiers
from tessella.operators import relational, sorting, text_sink
from tessella.operators.frame import Frame
from tessella.operators.index import KeyIndex
from tessella.plans import database_queries
from tessella.storage import remember, shared_dir


def _scan(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return relational.scan(spark, f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "orders").to_df()


def select_eq_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.select_equal(_scan(spark, sf_dir, "lineitem"), "l_linenumber", 6).to_df()


def select_eq_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.select_equal(_scan(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING").to_df()


def select_conj(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = relational.select_equal(_scan(spark, sf_dir, "lineitem"), "l_linenumber", 6)
    return relational.select_equal(six, "l_returnflag", "A").to_df()


def project_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.project_positions(_scan(spark, sf_dir, "part"), [3, 0]).to_df()


def project_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.project_names(_scan(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]).to_df()


def join_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.hash_join(_scan(spark, sf_dir, "customer"), _scan(spark, sf_dir, "orders"), "c_custkey", "o_custkey").to_df()


def join_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = relational.project_names(_scan(spark, sf_dir, "documents"), ["doc_id", "text"])
    joined = relational.hash_join(documents, documents, "text", "text")
    return relational.project_positions(joined, [0, 2]).to_df().toDF("doc_id", "doc_id2")


def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: nation, customer, orders and lineitem with two equality filters."""
    nation = relational.select_equal(_scan(spark, sf_dir, "nation"), "n_name", "NATION_7")
    customers = relational.hash_join(nation, _scan(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey")
    orders = relational.hash_join(customers, _scan(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    items = relational.select_equal(_scan(spark, sf_dir, "lineitem"), "l_linenumber", 1)
    joined = relational.hash_join(orders, items, "o_orderkey", "l_orderkey")
    return relational.project_names(joined, ["n_name", "c_name", "o_orderkey", "l_extendedprice"]).to_df()


def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _scan(spark, sf_dir, "nation")
    joined = relational.hash_join(nation, nation, "n_regionkey", "n_regionkey")
    return relational.project_names(joined, ["n_nationkey"]).to_df().toDF("k1", "k2")


def print_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sink.lines(_scan(spark, sf_dir, "nation"))


def sort_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice", "o_orderkey")
    return sorting.ranked(orders, "o_totalprice", "o_orderkey").select("rn", "o_orderkey")


def sort_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice", "o_orderkey")
    return sorting.order_violations(sorting.ranked(orders, "o_totalprice", "o_orderkey"), "o_totalprice")


def tid_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    packed = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", identifiers.merge_tid(F.expr("o_orderkey div 1000"), key % 1000).alias("tid"))
    page, slot = identifiers.split_tid(F.col("tid"))
    return packed.select("o_orderkey", "tid", page.alias("page"), slot.alias("slot"))


def pageid_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    packed = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", identifiers.merge_page_id(key % 100, key).alias("page_id"))
    segment, page = identifiers.split_page_id(F.col("page_id"))
    return packed.select("o_orderkey", "page_id", segment.alias("segment"), page.alias("page"))


def char_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(identifiers.pad_char(F.col("n_name"), 8).alias("c8"))


def register_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.columns_equal(_scan(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def _order_index(spark: SparkSession, sf_dir: str) -> KeyIndex:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return KeyIndex(orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("tid")))


def idx_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("tid"))
    return KeyIndex(entries).insert(entries.filter("k < 3")).entries


def _sevenths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("k"))


def idx_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved index without every seventh key, probed with all of the table's keys and as many absent ones."""
    path = remember(f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    _order_index(spark, sf_dir).erase(_sevenths(spark, sf_dir)).save(path)
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    return KeyIndex.load(spark, path).lookup(keys.union(keys.select(-1 - F.col("k"))))


def idx_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_index(spark, sf_dir).erase(_sevenths(spark, sf_dir)).entries


def idx_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_index(spark, sf_dir).size()


QUERIES = {
    f.__name__: f
    for f in (
        scan,
        select_eq_int,
        select_eq_str,
        select_conj,
        project_idx,
        project_name,
        join_int,
        join_str,
        join_chain,
        self_join,
        print_text,
        sort_external,
        sort_check,
        tid_codec,
        pageid_codec,
        char_pad,
        register_eq,
        idx_insert,
        idx_lookup,
        idx_erase,
        idx_size,
    )
} | database_queries.QUERIES

ORACLE_SQL = {
    "scan": "SELECT * FROM orders",
    "select_eq_int": "SELECT * FROM lineitem WHERE l_linenumber = 6",
    "select_eq_str": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "select_conj": "SELECT * FROM lineitem WHERE l_linenumber = 6 AND l_returnflag = 'A'",
    "project_idx": "SELECT p_type, p_partkey FROM part",
    "project_name": "SELECT l_orderkey, l_partkey FROM lineitem",
    "join_int": "SELECT c.*, o.* EXCLUDE (o_custkey) FROM customer c JOIN orders o ON c_custkey = o_custkey",
    "join_str": "SELECT a.doc_id, b.doc_id AS doc_id2 FROM documents a JOIN documents b ON a.text = b.text",
    "join_chain": "SELECT n_name, c_name, o_orderkey, l_extendedprice FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE n_name = 'NATION_7' AND l_linenumber = 1",
    "self_join": "SELECT a.n_nationkey AS k1, b.n_nationkey AS k2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "print_text": "SELECT concat_ws(', ', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)) AS line FROM nation",
    "sort_external": "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, o_orderkey FROM orders",
    "sort_check": "WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders), l AS (SELECT v, lag(v) OVER (ORDER BY rn) AS p FROM s) SELECT count(*) AS violations FROM l WHERE v < p",
    "tid_codec": "SELECT o_orderkey, ((o_orderkey // 1000) << 16) | (o_orderkey % 1000) AS tid, o_orderkey // 1000 AS page, o_orderkey % 1000 AS slot FROM orders",
    "pageid_codec": "SELECT o_orderkey, ((o_orderkey % 100) << 48) | o_orderkey AS page_id, o_orderkey % 100 AS segment, o_orderkey AS page FROM orders",
    "char_pad": "SELECT rpad(n_name, 8, ' ') AS c8 FROM nation",
    "idx_insert": "SELECT n_nationkey AS k, n_regionkey AS tid FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 3",
    "idx_lookup": "WITH p AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -1 - o_orderkey FROM orders) "
    "SELECT p.k, t IS NOT NULL AS found, coalesce(t, 0) AS tid FROM p LEFT JOIN (SELECT o_orderkey AS key, o_custkey AS t FROM orders WHERE o_orderkey % 7 <> 0) ON p.k = key",
    "register_eq": "SELECT l_orderkey = l_suppkey AS equal FROM lineitem",
    "idx_erase": "SELECT o_orderkey AS k, o_custkey AS tid FROM orders WHERE o_orderkey % 7 <> 0",
    "idx_size": "SELECT count(*) AS n FROM orders",
} | database_queries.ORACLE_SQL
