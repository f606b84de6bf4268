"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

import os

import pytest

import __spark_entry__ as entry
from verify import connect, rows_of

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(D)


def core():
    return {k: v for k, v in entry.queries().items() if "sedgemill.llm" not in v.__module__}


@pytest.mark.parametrize("name", sorted(core()))
def test_query(spark, con, name):
    df = core()[name](spark, D)
    got, sql = rows_of([tuple(r) for r in df.collect()], df.columns), entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(cur.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_table", "ref_id", "state"]
