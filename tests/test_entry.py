import os

import duckdb
import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_sql_names_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    want = con.execute(contract.oracle_sql()[name])
    cols = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in cols]
    text = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    expected = sorted([text(r[i]) for i in order] for r in want.fetchall())
    df = contract.queries()[name](spark, SMALL)
    assert sorted(df.columns) == cols
    assert sorted([text(r[c]) for c in cols] for r in df.collect()) == expected
