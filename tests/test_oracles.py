"""Every engine query against its DuckDB SQL, on the smallest driver tables."""

import glob
import math
import os

import duckdb
import pytest

from sparkwarden.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(int(v)) if math.isclose(v, round(v)) else repr(round(v, 6))
        return repr(int(v)) if hasattr(v, "__index__") else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_most_queries_have_an_oracle():
    assert len(registry.ORACLES) >= 0.9 * len(registry.QUERIES)
