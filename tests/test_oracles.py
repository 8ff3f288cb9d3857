"""Every query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def keyed(rows):
    return sorted(tuple((0, "") if x is None else (1, round(x, 9)) if isinstance(x, float) else (2, str(x)) for x in row) for row in rows)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert rows
    if name in registry.ORACLE_SQL:
        with duckdb.connect() as con:
            for t in NAMES:
                con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
            found = con.sql(registry.ORACLE_SQL[name])
            assert sorted(found.columns) == columns
            at = [found.columns.index(c) for c in columns]
            assert keyed(rows) == keyed([tuple(r[i] for i in at) for r in found.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
