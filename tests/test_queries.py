"""Every registered query of the engine against its SQL, at the smallest scale."""

import datetime as dt
import decimal

import duckdb
import pytest

from tarnlight.plans.oracles import ORACLE_SQL
from tarnlight.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.date() if isinstance(v, dt.datetime) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = sql.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", ["logreg_scores", "snapshot_signals"])
def test_model_queries_run(spark, name):
    """At the scale at which the cutoff day has something to send."""
    out = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert out and all(0 <= (r["market_score"] if name == "snapshot_signals" else r["score"]) <= 1 for r in out)


def test_contract():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
