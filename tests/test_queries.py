"""Every query with an oracle, side by side with DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from tidemark.plans import catalog_queries as Q

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", ["order_nulls_all", "order_nulls_desc_all"])
def test_all_rows_are_in_order(spark, duck, name):
    mine, theirs = [tuple(r) for r in Q.QUERIES[name](spark, SF).collect()], duck.execute(Q.ORACLE_SQL[name]).fetchall()
    assert mine == theirs and len(mine) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_unknown_versions_are_met(spark):
    assert Q.QUERIES["vfk_join_cascade_all"](spark, SF).where("as_of IS NULL").count() > 0
    assert Q.QUERIES["vfk_join_version_all"](spark, SF).where("l_linenumber % 4 <> 1 AND l_orderkey % 3 <> 0").count() > 0
