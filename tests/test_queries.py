"""Every query of the event engine against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from tagloom.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    want = db.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr([tidy(r[i]) for i in at]) for r in want.fetchall())


def test_roundtrip_events_does_not_compute_what_was_written_again(spark, db):
    """A parse reads its documents several times, so the parse and the writing before it must not stand in its plan."""
    plan = QUERIES["roundtrip_events"](spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert "l_orderkey" in plan and "l_linenumber" not in plan
