"""Every registered plan against its SQL on the smallest tables. DuckDB runs in a process of its own."""

import json
import os
import subprocess
import sys

import pytest

from tests.conftest import SF

RUN = r"""
import duckdb, glob, json, os, sys
sql, sf, out = json.load(open(sys.argv[1])), sys.argv[2], sys.argv[3]
c = duckdb.connect()
for f in glob.glob(sf + "/*.parquet"):
    c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
def flat(v):
    return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
bad = {}
for name, text in sql.items():
    want = c.execute(text)
    cols = sorted(d[0] for d in want.description)
    a = c.execute(f"SELECT {', '.join(f'{chr(34)}{x}{chr(34)}' for x in cols)} FROM ({text}) q").fetchall()
    b = c.execute(f"SELECT {', '.join(f'{chr(34)}{x}{chr(34)}' for x in cols)} FROM '{out}/{name}/*.parquet'").fetchall()
    a, b = (sorted((tuple(map(flat, r)) for r in rows), key=repr) for rows in (a, b))
    if a != b:
        bad[name] = [len(a), len(b), repr(a[:2]), repr(b[:2])]
print(json.dumps(bad))
"""


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    from wordmill import plans

    out = tmp_path_factory.mktemp("plans")
    for name, query in plans.QUERIES.items():
        query(spark, SF).write.parquet(f"{out}/{name}")
    return out


def test_plans_equal_their_sql(results):
    from wordmill import plans

    (results / "sql.json").write_text(json.dumps(plans.ORACLE_SQL))
    done = subprocess.run([sys.executable, "-c", RUN, str(results / "sql.json"), SF, str(results)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout) == {}


def test_plans_without_sql_give_rows(results, spark):
    from wordmill import plans

    for name in set(plans.QUERIES) - set(plans.ORACLE_SQL):
        assert os.path.isdir(results / name)
        assert spark.read.parquet(f"{results}/{name}").count() > 0, name


def test_entry_imports_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
