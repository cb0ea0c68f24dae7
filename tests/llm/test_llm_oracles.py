from __future__ import annotations

import duckdb
import pytest

from runhealth.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted((tuple(repr(r[i]) for i in at) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    path = small.replace("0.001", "0.01")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    cursor = db.execute(queries.oracle_sql()[name])
    want = plain(cursor.fetchall(), [c[0] for c in cursor.description])
    frame = queries.queries()[name](spark, path)
    assert plain(frame.collect(), frame.columns) == want


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
