"""Every registered query of the rating engine against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from rankwright import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(rows):
    out = []
    for row in rows:
        out.append(tuple(None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x for x in row))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    assert got or name in ("clutch_events", "forced_roster")
    if name in plans.oracle_sql():
        want = duck.sql(plans.oracle_sql()[name])
        assert sorted(want.columns) == columns
        want = plain(want.select(*(f'"{c}"' for c in columns)).fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            for x, y in zip(a, b):
                assert x == y or (isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-6, abs_tol=2e-6)), (name, a, b)
