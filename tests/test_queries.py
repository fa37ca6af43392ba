"""Every query against its SQL on the smallest tables, and what the driver expects of the entry points."""

from __future__ import annotations

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from waymark.plans import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def table(rows, columns):
    return sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in ([r[c] for c in columns] for r in rows))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name in oracles.oracle_sql():
        columns = sorted(df.columns)
        found = sql.execute(oracles.oracle_sql()[name])
        own = [d[0] for d in found.description]
        assert sorted(own) == columns
        assert table(rows, columns) == table([dict(zip(own, r, strict=True)) for r in found.fetchall()], columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["track_id", "seq", "lat", "lng", "ele", "bearing"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_corpus_operators():
    for p in [*ROOT.glob("waymark/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in p.parts and p.exists() and p.name != "test_queries.py":
            assert not re.search(r"waymark\.llm|corpus_pipeline", p.read_text()), p
