import glob
import os

import duckdb
import pytest

from basketry import plans

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in plans.queries().items() if sql])
def test_query_says_what_sql_says(spark, name):
    query, sql = plans.queries()[name]
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = query(spark, DATA)
    told = con.execute(sql)
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(got.columns)

    def plain(v):
        return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    assert sorted(map(str, ([plain(v) for v in r] for r in got.select(*columns).collect()))) == sorted(map(str, ([plain(v) for v in r] for r in told.fetchall())))
