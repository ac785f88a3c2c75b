"""Every registered query with an oracle gives the oracle's rows."""

import glob
import os

import duckdb
import pytest

from linkledger.plans import registry, sheets, stored  # noqa: F401

SAMPLE = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    db.execute(registry.ORACLES[name])
    names = [x[0] for x in db.description]
    assert sorted(names) == cols
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in db.fetchall())
    assert got == want
