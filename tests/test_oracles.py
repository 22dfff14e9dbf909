"""Registered queries against their DuckDB oracles over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from stallmark import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["rank_products", "card_listings", "scan_health", "source_pages", "source_conflicts", "knowledge_audit", "scan_failures", "fetch_order"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0

    def rows(df):
        return sorted(repr([None if pd.isna(v) else float(v) if isinstance(v, int | float) or hasattr(v, "dtype") else v for v in r]) for r in df[columns].itertuples(index=False, name=None))

    assert rows(got) == rows(want)
