"""Iterative operators against plain versions on small graphs."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
import pytest

from reelspark.operators import graphs as gr
from reelspark.operators import iterative as it
from reelspark.operators.skew import lookup_join
from reelspark.session import Shelf


@pytest.fixture
def graph():
    rng = random.Random(4)
    e = {tuple(sorted((f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}"))) for _ in range(55)}
    return sorted((a, b) for a, b in e if a != b)


def neighbours(edges):
    nb = {}
    for a, b in edges:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    return nb


def frame(spark, edges):
    return spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")


def test_components(spark, graph):
    edges = [e for e in graph if hash(e) is not None][:22] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)]
    nb, label = neighbours(edges), {}
    for s in sorted(nb):
        if s not in label:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = s
                    todo += nb[x]
    assert {r.node: r.component for r in it.components(frame(spark, edges), Shelf(spark, "t")).collect()} == label


def test_k_core(spark, graph):
    nb, want, k = neighbours(graph), {}, 0
    while nb:
        low = min(nb, key=lambda x: len(nb[x]))
        k = max(k, len(nb[low]))
        want[low] = k
        for y in nb.pop(low):
            nb[y].discard(low)
    assert {r.node: r.core for r in gr.core_numbers(frame(spark, graph), Shelf(spark, "t")).collect()} == want


def test_pagerank(spark, graph):
    nodes = sorted({x for e in graph for x in e})
    ix = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in graph:
        m[ix[b], ix[a]] += 1
    out = m.sum(0)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(200):
        r = 0.85 * (m @ np.divide(r, out, where=out > 0, out=np.zeros_like(r)) + r[out == 0].sum() / len(nodes)) + 0.15 / len(nodes)
    got = {x.node: x.rank for x in it.pagerank(frame(spark, graph), Shelf(spark, "t"), tol=1e-9).collect()}
    assert all(abs(got[x] - r[ix[x]]) < 1e-6 for x in nodes) and abs(sum(got.values()) - 1) < 1e-6


def test_birank(spark):
    rng = np.random.default_rng(2)
    w = rng.random((7, 5)) * (rng.random((7, 5)) < 0.6)
    w[:, 0] += 0.1
    w[0, :] += 0.1
    rows = [(f"p{i}", f"w{j}", float(w[i, j])) for i in range(7) for j in range(5) if w[i, j] > 0]
    t, s = w / w.sum(0), w / w.sum(1, keepdims=True)
    p, u = np.full(7, 1 / 7), np.full(5, 1 / 5)
    for _ in range(100):
        p2, u2 = 0.85 * t @ u + 0.15 / 7, 0.85 * s.T @ p + 0.15 / 5
        p2, u2 = p2 / p2.sum(), u2 / u2.sum()
        gap = max(abs(p2 - p).max(), abs(u2 - u).max())
        p, u = p2, u2
        if gap < 1e-6:
            break
    gp, gu = it.birank(spark.createDataFrame(rows, "person string, work string, weight double"), Shelf(spark, "t"))
    assert all(abs(r["rank"] - p[int(r.person[1:])]) < 1e-9 for r in gp.collect())
    assert all(abs(r["rank"] - u[int(r.work[1:])]) < 1e-9 for r in gu.collect())


def test_two_way_effects_recover_truth(spark):
    rng = np.random.default_rng(3)
    pe, se = rng.normal(size=12), rng.normal(size=4)
    rows = [(f"p{i}", f"s{j}", float(pe[i] + se[j]), float(rng.random() + 0.5)) for i in range(12) for j in range(4) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "person string, studio string, y double, w double")
    p, s = it.two_way_effects(df, Shelf(spark, "t"), tol=1e-10)
    sd = {r.studio: r.effect for r in s.collect()}
    assert abs(sum(sd.values())) < 1e-6
    pd = {r.person: r.effect for r in p.collect()}
    assert all(abs(pd[a] + sd[b] - y) < 1e-4 for a, b, y, _ in rows)
    shrunk = {r.person: r.shrunk for r in it.shrink_effects(df, p, s).collect()}
    mu = sum(pd.values()) / len(pd)
    assert all(abs(shrunk[x] - mu) <= abs(pd[x] - mu) + 1e-9 for x in pd)


def test_betweenness(spark, graph):
    nb = neighbours(graph)
    score = dict.fromkeys(nb, 0.0)
    for s in nb:
        dist, paths, order, q = {s: 0}, {s: 1.0}, [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in nb[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in nb[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    n = len(nb)
    got = {r.node: r.score for r in it.betweenness(frame(spark, graph), Shelf(spark, "t")).collect()}
    assert all(abs(got[x] - score[x] / ((n - 1) * (n - 2))) < 1e-9 for x in nb)


def test_communities_split_two_cliques(spark):
    edges = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0")]
    got = {r.node: r.community for r in gr.louvain(frame(spark, edges), Shelf(spark, "t")).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]


def plain_modularity(edges, com):
    deg, m = {}, len(edges)
    for a, b in edges:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    tot = {}
    for x, k in deg.items():
        tot[com[x]] = tot.get(com[x], 0) + k
    return sum(com[a] == com[b] for a, b in edges) / m - sum(t * t for t in tot.values()) / (4 * m * m)


def test_louvain_finds_planted_groups(spark):
    rng = random.Random(8)
    nodes = [(c, f"{c}{i}") for c in "abcd" for i in range(8)]
    edges = [(x, y) for i, (c, x) in enumerate(nodes) for e, y in nodes[i + 1 :] if rng.random() < (0.8 if c == e else 0.04)]
    com = {r.node: r.community for r in gr.louvain(frame(spark, edges), Shelf(spark, "t")).collect()}
    assert all(com[x] == f"{c}0" for c, x in nodes)
    df = spark.createDataFrame([(k, v) for k, v in com.items()], "node string, community string")
    assert abs(gr.modularity(frame(spark, edges), df) - plain_modularity(edges, com)) < 1e-12


def test_triangles_and_reach(spark, graph):
    nb = neighbours(graph)
    edges = frame(spark, graph)
    ids, e = gr.oriented(edges, Shelf(spark, "t"))
    name = {r.i: r.node for r in ids.collect()}
    assert sorted(name) == list(range(len(nb)))
    got = {(min(name[r.lo], name[r.hi]), max(name[r.lo], name[r.hi])): (r.common, r.s) for r in gr.edge_triangles(e).collect()}
    want = {(a, b): nb[a] & nb[b] for a, b in graph if nb[a] & nb[b]}
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(got[k][1] - sum(1 / len(nb[x]) for x in v)) < 1e-12 for k, v in want.items())
    reach = {r.node: r.n_reached for r in gr.two_step_reach(edges, Shelf(spark, "t")).collect()}
    assert reach == {a: len((nb[a] | {c for b in nb[a] for c in nb[b]}) - {a}) for a in nb}


def test_eigenvector(spark, graph):
    edges = graph + [("n00", "n01"), ("n01", "n02"), ("n00", "n02"), ("z1", "z2")]
    edges = sorted({tuple(sorted(e)) for e in edges})
    got = {r.node: r.score for r in gr.eigenvector(frame(spark, edges), Shelf(spark, "t"), 1e-10).collect()}
    nodes = sorted(got)
    ix = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        if a in ix and b in ix:
            m[ix[a], ix[b]] = m[ix[b], ix[a]] = 1
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    assert "z1" not in got and all(abs(got[x] - v[ix[x]]) < 1e-6 for x in nodes)


def test_shortest_paths(spark, graph):
    nb = neighbours(graph)
    nodes = sorted(nb)
    asked = [(a, b) for a in nodes[:4] for b in nodes]
    got = {(r.source, r.target): (r.hops, r.paths, tuple(r.path)) for r in gr.shortest_paths(frame(spark, graph), spark.createDataFrame(asked, "source string, target string"), Shelf(spark, "t"), 30).collect()}
    want = {}
    for s in nodes[:4]:
        level = {s: (1, (s,))}
        seen, k = set(), 0
        while level:
            for x, (n, p) in level.items():
                want[s, x] = (k, n, p)
            seen |= set(level)
            nxt, k = {}, k + 1
            for x, (n, p) in level.items():
                for y in nb[x] - seen:
                    m, q = nxt.get(y, (0, None))
                    nxt[y] = (m + n, p + (y,) if q is None else min(q, p + (y,)))
            level = nxt
    assert got == want


def test_value_weights(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=40)
    rows = [(f"p{i}", float(a[i]), float(a[i] + rng.normal() * 0.1), None if i == 3 else float(rng.normal()), 0.5 if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "person string, x double, y double, z double, f double")
    w = it.principal_weights(df, ["x", "y", "z"])
    assert abs(sum(w.values()) - 1) < 1e-9 and w["z"] < w["x"] and it.principal_weights(df.limit(5), ["x", "y"]) == {"x": 0.5, "y": 0.5}
    v = [r.value for r in it.integrated_value(df, ["x", "y", "z"], w, "f").collect()]
    assert min(v) == 0.0 and max(v) == 1.0


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    from reelspark.operators import skew

    facts = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"c{i}", i) for i in range(20)], "k string, v int")
    lookup = facts.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "concat(k, '!') as name", "n")
    want = sorted(tuple(r) for r in facts.join(lookup.drop("n"), "k").collect())
    for rows in (5, 1000):
        monkeypatch.setattr(skew, "HOT_ROWS", rows)
        assert sorted(tuple(r) for r in lookup_join(facts, 70, lookup, "k", "n").select("k", "v", "name").collect()) == want
