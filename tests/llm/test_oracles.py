"""Queries against their SQL in another engine, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from skein.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_other_engine_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(object).where(x[cols].notna(), None).sort_values(cols, key=lambda s: s.astype(str)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
