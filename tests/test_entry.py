"""Every registered query against its DuckDB counterpart on the smallest test set."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from salesmerge.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLES = oracles.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


def test_the_rest_works_without_the_training_text_operators(tmp_path):
    """A copy without both folders and the pipeline imports, with all other queries and SQL."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "repo"
    shutil.copytree(
        root, copy, ignore=lambda folder, names: [
            n for n in names if n in ("llm", ".git", "__pycache__") or n == "corpus_pipeline.py"
        ],
    )
    script = (
        "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
        "assert not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; "
        "assert set(o) <= set(q) and len(q) > 60; print(len(q))"
    )
    ran = subprocess.run([sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
