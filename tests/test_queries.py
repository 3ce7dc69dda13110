"""Every registered query of the core against its SQL twin, and the driver's entry points."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from brookspan.plans import nexmark_queries, queries, surface_queries

ROOT = Path(__file__).resolve().parents[1]
QUERIES = queries.QUERIES | nexmark_queries.QUERIES | surface_queries.QUERIES
ORACLES = queries.ORACLES | nexmark_queries.ORACLES | surface_queries.ORACLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    base = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        base.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return base


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    places = [wanted.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in places)) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points_need_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
