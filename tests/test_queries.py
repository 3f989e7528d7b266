"""Every registered query with SQL gives the same rows in DuckDB."""

import math
import os

import pytest

from loomfield.plans import feed, intake, relational, texts, tracker, wording  # noqa: F401
from loomfield.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    key = sorted(columns)
    got = sorted(repr([plain(r[c]) for c in key]) for r in df.collect())
    want = sorted(repr([plain(dict(zip(columns, r))[c]) for c in key]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_others_run(spark, name):
    QUERIES[name](spark, FOLDER).count()
