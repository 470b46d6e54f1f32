"""Every registered query; those with an SQL twin against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
# Boosting takes a hundred rounds; its pieces are tested in test_regressors.
BOOSTED = {
    "gradient_boosting", "boosting_depth6", "model_comparison", "rank_models", "predictions",
    "save_load_model",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def _text(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert sorted(names) == sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    order = sorted(names)
    ours = sorted(tuple(_text(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = sorted(tuple(_text(r[i]) for i in at) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - BOOSTED))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
