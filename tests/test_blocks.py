"""Operators on blocks of neighbour lists against plain versions and against the operators on edges."""

from __future__ import annotations

import itertools
import math
import random
from pathlib import Path

import pytest

from reelspark.operators import blocks, graphs, iterative
from reelspark.session import Shelf

TEAM = "work string, person string, lead boolean, a double, imp double"


@pytest.fixture
def team():
    """Works with and without leading members, of one person, and one hub in many works."""
    rng, rows = random.Random(5), []
    for w in range(40):
        crew = {f"n{rng.randrange(60):02d}" for _ in range(rng.randrange(1, 7))} | ({"n07"} if w % 3 == 0 else set())
        leads = set(rng.sample(sorted(crew), min(len(crew), rng.randrange(1, 3))))
        rows += [(f"w{w}", p, p in leads, 1.0 + (w % 5), 0.5 + w % 2) for p in sorted(crew)]
    return [*rows, ("alone", "x", True, 1.0, 1.0)]


def tied(rows):
    """{(src, dst): [shared, weight]} of the pairs of a work with a leading side."""
    out = {}
    for _, g in itertools.groupby(rows, key=lambda r: r[0]):
        for x, y in itertools.combinations(sorted(g, key=lambda r: r[1]), 2):
            if x[2] or y[2]:
                e = out.setdefault((x[1], y[1]), [0, 0.0])
                e[0], e[1] = e[0] + 1, e[1] + x[3] * y[3] * x[4]
    return out


def partners(rows):
    nb = {}
    for a, b in tied(rows):
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    return nb


@pytest.mark.parametrize("dense", [blocks.DENSE, 3000])
def test_reach_of_teams(spark, team, monkeypatch, dense):
    monkeypatch.setattr(blocks, "DENSE", dense)  # one slice of nodes, or several
    nb = partners(team)
    got = {r.node: r.n_reached for r in blocks.two_step_reach(spark.createDataFrame(team, TEAM), Shelf(spark, "t")).collect()}
    assert got == {u: len((set.union(*(nb[v] for v in nb[u])) | nb[u]) - {u}) for u in nb}


def stored(shelf):
    return sum(f.stat().st_size for f in Path(shelf.root.removeprefix("file:")).rglob("*.parquet"))


def test_reach_keeps_teams_not_ties(spark):
    rows = [(f"w{k}", f"p{k}:{i:03d}", True, 1.0, 1.0) for k in range(4) for i in range(500)]
    shelf = Shelf(spark, "t")
    got = {r.n_reached for r in blocks.two_step_reach(spark.createDataFrame(rows, TEAM), shelf).collect()}
    assert got == {499} and stored(shelf) < 4 * 500 * 499 // 2  # not a byte a tie


@pytest.fixture
def small(monkeypatch):
    """Several blocks and several lots of pairs, as on large graphs."""
    monkeypatch.setattr(blocks, "ENTRIES", 60)
    monkeypatch.setattr(blocks, "PAIRS", 50)


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, k, w) for (a, b), (k, w) in tied(rows).items()], "src string, dst string, shared long, weight double")


def of_teams(spark, rows, what, weighted=True):
    return blocks.collaboration(spark.createDataFrame(rows, TEAM), Shelf(spark, what), weighted)


def test_communities_of_blocks(spark, team, small):
    g = of_teams(spark, team, "blocks")
    assert g.n > 2 * g.size
    got = {r.node: r.community for r in blocks.communities(g).collect()}
    assert got == {r.node: r.community for r in graphs.louvain(edges_of(spark, team), Shelf(spark, "edges")).collect()}
    assert len(set(got.values())) > 2


def test_bridges_of_blocks(spark, team, small):
    g = of_teams(spark, team, "blocks")
    com = {r.node: r.community for r in blocks.communities(g).collect()}
    size = {c: list(com.values()).count(c) for c in com.values()}
    want = {}
    for (a, b), (shared, _) in tied(team).items():
        for u, v in ((a, b), (b, a)):
            if com[u] != com[v]:
                x = want.setdefault(u, [set(), 0.0])
                x[0].add(com[v])
                x[1] += min(size[com[u]], size[com[v]]) ** 0.5 * math.log1p(shared)
    got = {r.node: (r.communities, round(r.score, 9)) for r in blocks.bridges(of_teams(spark, team, "again")).collect()}
    assert got == {u: (len(c), round(s, 9)) for u, (c, s) in want.items()}


def test_spread_of_blocks(spark, team, small):
    com = {r.node: r.community for r in blocks.communities(of_teams(spark, team, "blocks")).collect()}
    got = {r.node: (r.degree, r.communities) for r in blocks.spread_of_ties(of_teams(spark, team, "again")).collect()}
    assert got == {u: (len(vs), len({com[v] for v in vs})) for u, vs in partners(team).items()}


def test_triangles_and_constraint_of_blocks(spark, team, small):
    nb = partners(team)
    g = of_teams(spark, team, "blocks", False)
    name = {r.i: r.node for r in g.ids.collect()}
    t = {name[r.i]: r.t for r in blocks.closed(g).collect()}
    assert t == {u: sum(len(nb[u] & nb[v]) for v in nb[u]) // 2 for u in nb} and sum(t.values()) > 0
    got = {r.node: (r.k, round(r.constraint_, 9), r.redundant) for r in blocks.constraint(g).collect()}
    burt = lambda u: sum(((1 + sum(1 / len(nb[x]) for x in nb[u] & nb[v])) / len(nb[u])) ** 2 for v in nb[u])
    assert got == {u: (len(nb[u]), round(burt(u), 9), sum(len(nb[u] & nb[v]) - 1 for v in nb[u])) for u in nb}


def test_cores_of_blocks(spark, team, small):
    want = {r.node: r.core for r in graphs.core_numbers(edges_of(spark, team), Shelf(spark, "edges")).collect()}
    g = of_teams(spark, team, "blocks", False)
    got = blocks.cores(g)
    assert {r.node: r.core for r in got.collect()} == want
    nb, name = partners(team), {r.i: r.node for r in g.ids.collect()}
    share = {name[r.i]: r.share for r in blocks.share_of_partners(g, got.selectExpr("i", "core > 3 as x")).collect()}
    assert share == {u: sum(want[v] > 3 for v in nb[u]) / len(nb[u]) for u in nb}


def test_betweenness_of_blocks(spark, team, small, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE", 8 * 60 * 20)  # several groups of sources
    want = {r.node: round(r.score, 9) for r in iterative.betweenness(edges_of(spark, team), Shelf(spark, "edges")).collect()}
    assert {r.node: round(r.score, 9) for r in blocks.betweenness(of_teams(spark, team, "blocks", False)).collect()} == want


def test_paths_of_blocks(spark, team, small):
    g = of_teams(spark, team, "blocks", False)
    hub = blocks.most_tied(g)
    targets = spark.createDataFrame([(p,) for p in [*partners(team), "x", "absent"]], "target string")
    asked = targets.selectExpr(f"'{hub['node']}' as source", "target")
    want = {(r.target, r.hops, r.paths, tuple(r.path)) for r in graphs.shortest_paths(edges_of(spark, team), asked, Shelf(spark, "edges")).collect()}
    assert {(r.target, r.hops, r.paths, tuple(r.path)) for r in blocks.paths_from(g, hub["i"], targets).filter("hops > 0").collect()} == {w for w in want if w[1]}


def test_paths_of_blocks_go_to_the_end(spark, small):
    chain = [(f"w{k:02d}", p, True, 1.0, 1.0) for k in range(12) for p in (f"c{k:02d}", f"c{k + 1:02d}", f"d{k + 1:02d}")]
    g = of_teams(spark, chain, "long", False)
    targets = g.ids.select("node").toDF("target")
    got = {r.target: (r.hops, r.paths, r.path[-1]) for r in blocks.paths_from(g, g.ids.filter("node = 'c00'").first()["i"], targets).collect()}
    assert got == {t: (int(t[1:]), 1, t) for t in partners(chain)}


def test_paths_from_hub_reach_every_person(spark):
    import __spark_entry__

    q, data = __spark_entry__.queries(), "/root/testdata/sf0.001"
    nb = {}
    for r in q["collaboration_edges"](spark, data).collect():
        nb.setdefault(r.src, set()).add(r.dst)
        nb.setdefault(r.dst, set()).add(r.src)
    persons = {r[0] for r in spark.read.parquet(f"{data}/persons.parquet").selectExpr("lower(trim(id))").collect()}
    rows = q["paths_from_hub"](spark, data).collect()
    hops = {rows[0].source: 0}
    front = set(hops)
    while front:
        front = {v for u in front for v in nb[u]} - hops.keys()
        hops |= dict.fromkeys(front, max(hops.values()) + 1)
    assert {r.target: r.hops for r in rows} == {p: h for p, h in hops.items() if p in persons} and len(rows) > 50
    assert all(len(p) == r.hops + 1 and p[-1] == r.target and all(v in nb[u] for u, v in zip(p, p[1:])) for r in rows for p in [r.path.split(",")])


def test_eigenvector_of_blocks(spark, team, small):
    apart = [*team, *[("other", p, True, 1.0, 1.0) for p in ("y1", "y2", "y3")]]  # a smaller component
    want = {r.node: r.score for r in graphs.eigenvector(edges_of(spark, apart), Shelf(spark, "edges")).collect()}
    g = of_teams(spark, apart, "blocks", True)
    got = {r.node: r.score for r in blocks.eigenvector(g).join(g.ids, "i").collect()}
    assert got.keys() == want.keys() and "y1" not in got and all(abs(got[u] - want[u]) < 1e-9 for u in want)
    empty = of_teams(spark, [("alone", "x", True, 1.0, 1.0)], "empty", True)
    assert blocks.eigenvector(empty).collect() == []
