"""The registered queries against their SQL on the smallest tables, and the entry's independence."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from chronofold import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def key(row):
    return [f"{v:.3f}" if isinstance(v, float) else str(v) for v in row]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)
    if name in registry.ORACLE:
        relation = duck.sql(registry.ORACLE[name])
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=key)
        assert len(got) == len(want)
        assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_flagship(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0


def test_entry_imports_without_a_session_and_without_the_optional_package():
    code = "import sys; sys.modules['chronofold.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n[:2] == 'op' and n[2].isdigit() for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
