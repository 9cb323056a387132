"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest

from stackscan.llm import queries
from tests.llm.tables import SF


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = db.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    place = {c[0]: i for i, c in enumerate(result.description)}
    want = sorted(tuple(r[place[c]] for c in columns) for r in result.fetchall())
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == want
