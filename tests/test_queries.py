"""Every registered query runs on the smallest tables and agrees with its SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 5) + 0.0:.5f}"
    return f"{v:.5f}" if v.__class__.__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_agrees(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(same(v) for v in row) for row in r.fetchall())
    assert sorted(tuple(same(v) for v in row) for row in df.select(*cols).collect()) == want


def of(spark, name):
    return entry.queries()[name](spark, DATA)


def test_graph_queries_cover_the_whole_graph(spark):
    ends = {x for r in of(spark, "collaboration_edges").select("src", "dst").collect() for x in r}
    core = {r.person: r.core for r in of(spark, "core_numbers").collect()}
    assert set(core) == ends and min(core.values()) >= 1
    assert {r.person for r in of(spark, "communities").collect()} == ends


def test_values_and_ranks_are_scaled(spark):
    values = [r.value for r in of(spark, "integrated_values").collect()]
    assert len(values) > 50 and min(values) == 0.0 and max(values) == 1.0
    assert abs(sum(r["rank"] for r in of(spark, "bipartite_rank").collect()) - 1) < 1e-5
    p = of(spark, "person_effects").collect()
    assert len(p) > 50 and len({r.person for r in p}) == len(p) and all(r.n >= 1 for r in p)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
