"""Every query of the catalog gives what its SQL gives; plans have the shape that scales."""

import duckdb
import pytest

import __spark_entry__ as contract
from basalt.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return "~" if value is None else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(catalog.ORACLE_SQL[name])
    at = [d[0] for d in cursor.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in cursor.fetchall())


def test_contract(spark, sf_dir):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalog.filtered_avg(spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in text
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text


@pytest.mark.parametrize("name, sorts", [("bucketed_join", 0), ("bucket_merge_join", 1)])
def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir, name, sorts):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    below = text.split("SortMergeJoin", 1)[1].split("== Initial", 1)[0]
    assert below.count("Exchange") == 0 and below.count("Sort [") == sorts


def test_partitions_of_the_fact_are_pruned_by_the_join(spark, sf_dir):
    assert "dynamicpruning" in plan(catalog.QUERIES["pruned_fact_rate"](spark, sf_dir))


def test_latest_per_key_limits_each_group_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(catalog.latest_per_key(spark, sf_dir))
