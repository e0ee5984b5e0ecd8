"""Every query of the relational engine against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalogue


def _key(rows):
    return sorted(tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_oracle(spark, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    wanted = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(wanted.columns) == names
    rows = found.select(*names).collect()
    assert _key(rows) == _key(wanted.select(*names).fetchall())


def test_entry_is_not_empty(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.count() == 15
    assert found.columns == ["n_name", "c_name", "o_orderkey", "l_extendedprice"]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["join_chain"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan
