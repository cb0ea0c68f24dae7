"""Every query with SQL against DuckDB, the others by count and schema."""

from __future__ import annotations

import decimal
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from runhealth.plans import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 9))
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


def rows(found, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(columns), sorted(tuple(plain(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, small, db, name):
    cursor = db.execute(oracle.oracle_sql()[name])
    want = rows(cursor.fetchall(), [c[0] for c in cursor.description])
    frame = catalog.queries()[name](spark, small)
    assert rows(frame.collect(), frame.columns) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(oracle.oracle_sql())))
def test_other_queries_run(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_streamed_checks_agree_with_batch_where_settled(spark, small):
    live = {r["fix_id"]: r for r in catalog.queries()["verify_stream"](spark, small).collect()}
    tables = catalog.Tables(spark, small)
    from runhealth.functions.remedy import fix_id
    from pyspark.sql import functions as F

    fixes = tables.fixes.join(tables.suggestions.select("fix_id", "run_id"), "fix_id") \
        .withColumn("fix_id", fix_id(F.col("run_id"), F.lit("live"))).drop("run_id")
    from runhealth.operators.verify import verify_next_run

    batch = verify_next_run(fixes, tables.issue_runs, catalog.DAY_SCALE_TIMEOUT).collect()
    assert len(live) == len(batch)
    settled = [r for r in batch if live[r["fix_id"]]["outcome"] != "open"]
    assert len(settled) > len(batch) // 2
    assert all(live[r["fix_id"]]["outcome"] == r["outcome"] for r in settled)


def test_imports_without_a_session():
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100"], cwd=root)
    assert done.returncode == 0
