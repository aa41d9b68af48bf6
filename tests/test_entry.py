"""The driver's contract: every query runs at the smallest scale and agrees with its SQL."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from cairn import queries as core

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{TABLES}/lineitem.parquet'")
    return c


def rows(table):
    return sorted((tuple(None if isinstance(v, float) and v != v else v for v in r) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, oracle, name):
    df = core.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    if name in core.oracle_sql():
        want = oracle.execute(f"SELECT {', '.join(columns)} FROM ({core.oracle_sql()[name]})").fetchall()
        assert got == rows(want)
    else:
        assert got


@pytest.mark.parametrize("name", ["header_roundtrip", "vpc_roundtrip"])
def test_round_trips_have_all_points(spark, oracle, name):
    (n,) = oracle.execute("SELECT count(*) FROM lineitem").fetchone()
    assert sum(r["points"] for r in core.queries()[name](spark, TABLES).collect()) == n


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    """The entry imports and the other queries are there when the llm folders and the pipeline aren't."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "cairn"):
        source, target = os.path.join(root, name), tmp_path / name
        if os.path.isfile(source):
            target.write_bytes(open(source, "rb").read())
            continue
        for folder, folders, files in os.walk(source):
            folders[:] = [f for f in folders if f not in ("llm", "__pycache__")]
            to = target / os.path.relpath(folder, source)
            to.mkdir(parents=True, exist_ok=True)
            for f in files:
                (to / f).write_bytes(open(os.path.join(folder, f), "rb").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bbox_filter' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
