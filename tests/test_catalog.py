"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docloom.plans import catalog

HERE = "/root/testdata/sf0.001"


def canonical(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        return (2, f"{float(v):.9g}") if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else (3, str(v))

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{HERE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, HERE)
    cols = sorted(df.columns)
    got = duck.execute(catalog.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert want or name == "digit_runs", "an empty result shows nothing"  # the smallest documents hold no such run
    assert canonical(tuple(r) for r in df.select(*cols).collect()) == canonical(want)
