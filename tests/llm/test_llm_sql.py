"""Queries that SQL expresses, on whole tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from conftest import FOLDER
from turnlake.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, name):
    with duckdb.connect() as db:
        for table in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        found = db.execute(catalog.ORACLES[name])
        columns = [d[0] for d in found.description]
        want = Counter(found.fetchall())
    rows = catalog.QUERIES[name](spark, FOLDER)
    assert set(rows.columns) == set(columns)
    assert Counter(map(tuple, rows.select(*columns).collect())) == want
