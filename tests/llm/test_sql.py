"""The operators that SQL can express, against DuckDB at the smallest scale."""

import duckdb
import pytest

from govlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    c = con.execute(ORACLE[name])
    columns = sorted(x[0] for x in c.description)
    assert sorted(df.columns) == columns
    want = sorted(str([r[[x[0] for x in c.description].index(k)] for k in columns]) for r in c.fetchall())
    assert sorted(str([r[k] for k in columns]) for r in df.collect()) == want
