"""Training-data queries against their SQL."""

import duckdb
import pytest

from vigil.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False)))
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.sql(ORACLES[name]).df())
