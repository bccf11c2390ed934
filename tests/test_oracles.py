"""Each registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from catchwater.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(table):
    return sorted(map(repr, ([None if v is None else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r] for r in table)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())
