"""Every query against its SQL on the same tables."""

import duckdb
import pytest

from vigil.plans.oracles import ORACLES
from vigil.plans.queries import QUERIES

TABLES = ("customer", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return list(df.columns), sorted(map(str, df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.fixture(scope="module")
def far(sf, tmp_path_factory):
    """Events of users whose made addresses pass the usual spellings: a third part over 255, a last part of five digits and more."""
    path = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    shifts = ", ".join(f"({k})" for k in (0, 65_536, 80_000, 200_000, 1_000_000, 70_000_000))
    con.execute(f"CREATE TABLE events AS SELECT event_id + 100000::BIGINT * k AS event_id, ts, user_id + k AS user_id, * EXCLUDE (event_id, ts, user_id, k) FROM '{sf}/events.parquet', (VALUES {shifts}) s(k)")
    con.execute(f"COPY events TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path), con


@pytest.mark.parametrize("name", ["geo_country", "country_counts", "known_bad", "allowlist_filter"])
def test_addresses_of_many_users(spark, far, name):
    path, con = far
    assert rows(QUERIES[name](spark, path).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
