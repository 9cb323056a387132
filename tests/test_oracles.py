"""Every registered query against its SQL on the smallest test tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stackscan.plans import registry  # noqa: E402
from tools.check import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracles()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    frame = registry.queries()[name](spark, SF)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        assert got[0]
        return
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert got == canonical(columns, result.fetchall())
