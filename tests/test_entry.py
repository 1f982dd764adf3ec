"""Every query with SQL gives the SQL's rows on the smallest tables; the rest of the library doesn't need the llm subpackage."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from sonargrid.plans import catalogue, problems

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = problems.QUERIES | catalogue.QUERIES
ORACLES = problems.ORACLES | catalogue.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def compare(spark, db, query, sql):
    df = query(spark, TABLES)
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    compare(spark, db, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_nothing_outside_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['sonargrid.llm'] = None; import pkgutil, importlib, sonargrid; [importlib.import_module(m.name) for m in pkgutil.walk_packages(sonargrid.__path__, 'sonargrid.') if not m.name.startswith('sonargrid.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
