"""Iterative graph and panel operators as driver loops over distributed steps.

Each loop chains a few rounds in one plan, then writes the state to the shared
folder and tests for the end, so plans stay short and a lost executor loses
nothing.  Nothing that grows with the graph comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Shelf

#: Rounds chained between two writes.
CHAIN = 4


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component) of undirected edges (src, dst): least node of each component, by minimum labels and pointer jumping."""
    both = shelf.put(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    cur = shelf.put(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("component")), "label0")
    k = 0
    while True:
        near = both.join(cur.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = cur.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = cur.select(F.col("node").alias("low"), F.col("component").alias("beyond"))
        new = shelf.put(step.join(jump, "low").select("node", F.least("low", "beyond").alias("new"), (F.least("low", "beyond") != F.col("component")).alias("moved")), f"label{k + 1}")
        done = new.filter("moved").isEmpty()
        cur = new.select("node", F.col("new").alias("component"))
        shelf.drop(f"label{k}")
        k += 1
        if done:
            return cur


def pagerank(edges: DataFrame, shelf: Shelf, damping: float = 0.85, tol: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, rank) of directed edges (src, dst, weight); ends when the ranks' total change is below n * tol."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    part = shelf.put(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "part")
    nodes = shelf.put(part.select(F.col("src").alias("node")).unionByName(part.select(F.col("dst").alias("node"))).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("sends")), "node", "left"), "nodes")
    n = nodes.count()
    cur = nodes.select("node", "sends", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(0, most, CHAIN):
        for _ in range(CHAIN):
            old = cur
            sent = part.join(cur.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
            loose = cur.agg(F.coalesce(F.sum(F.when(F.col("sends").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
            cur = nodes.join(sent, "node", "left").crossJoin(F.broadcast(loose))  # one row
            cur = cur.select("node", "sends", (damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n) + (1 - damping) / max(n, 1)).alias("rank"))
        cur = cur.join(old.select("node", F.col("rank").alias("old")), "node")
        cur = shelf.put(cur, f"rank{k}")
        moved = cur.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        cur = cur.select("node", "sends", "rank")
        if moved < n * tol:
            break
    return cur.select("node", "rank")


def birank(edges: DataFrame, shelf: Shelf, alpha: float = 0.85, beta: float = 0.85, tol: float = 1e-6, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(person, rank) and (work, rank) of weighted edges (person, work, weight).

    Persons draw on works divided by the work's total, works on persons divided
    by the person's total; both sides use the old values, are mixed with the
    uniform prior and scaled to sum 1.
    """
    p_sum = edges.groupBy("person").agg(F.sum("weight").alias("ps"))
    w_sum = edges.groupBy("work").agg(F.sum("weight").alias("ws"))
    e = shelf.put(edges.join(p_sum, "person").join(w_sum, "work").select("person", "work", (F.col("weight") / F.col("ws")).alias("t"), (F.col("weight") / F.col("ps")).alias("s")), "links")
    start = shelf.put(e.groupBy("person").agg(F.count("*").alias("k")), "birank_persons"), shelf.put(e.groupBy("work").agg(F.count("*").alias("k")), "birank_works")
    n_p, n_w = (x.count() for x in start)
    sides = {"p": ("person", "work", "t", alpha, n_p), "u": ("work", "person", "s", beta, n_w)}
    cur = {c: x.select(sides[c][0], F.lit(1.0 / max(sides[c][4], 1)).alias("rank")) for c, x in zip("pu", start, strict=True)}

    def step(c: str, other: DataFrame) -> DataFrame:
        # shares of a row sum to 1 on the other side, so ranks keep the sum 1
        key, far, part, mix, n = sides[c]
        return e.join(other, far).groupBy(key).agg((mix * F.sum(F.col(part) * F.col("rank")) + (1 - mix) / n).alias("rank"))

    for k in range(0, most, CHAIN):
        chain = [cur]
        for _ in range(CHAIN):
            chain.append({"p": step("p", chain[-1]["u"]), "u": step("u", chain[-1]["p"])})
        done, state = None, {}
        for c in "pu":
            key = sides[c][0]
            x = chain[0][c].withColumnRenamed("rank", "r0")
            for i in range(1, CHAIN + 1):
                x = x.join(chain[i][c].withColumnRenamed("rank", f"r{i}"), key)
            state[c] = shelf.put(x, f"{c}{k}")
        gaps = [[x or 0.0 for x in state[c].agg(*[F.max(F.abs(F.col(f"r{i}") - F.col(f"r{i - 1}"))) for i in range(1, CHAIN + 1)]).first()] for c in "pu"]
        done = next((i + 1 for i in range(CHAIN) if max(g[i] for g in gaps) < tol), None)
        cur = {c: state[c].select(sides[c][0], F.col(f"r{done or CHAIN}").alias("rank")) for c in "pu"}
        if done:
            break
    return cur["p"], cur["u"]


def two_way_effects(panel: DataFrame, shelf: Shelf, tol: float = 1e-8, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(person, effect) and (studio, effect) of a weighted panel (person, studio, y, w).

    Weighted means of the residuals are taken by person, then by studio, until
    neither changes by more than ``tol``; studio effects are then centred and
    the shift goes to the persons.
    """
    cell = shelf.put(panel.groupBy("person", "studio").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).filter("w > 0"), "cells")
    s = shelf.put(cell.groupBy("studio").agg(F.lit(0.0).alias("effect")), "s0")
    for k in range(0, most, CHAIN):
        state, cur = s.withColumnRenamed("effect", "r0"), s
        for i in range(1, CHAIN + 1):
            p = cell.join(cur, "studio").groupBy("person").agg((F.sum(F.col("wy") - F.col("w") * F.col("effect")) / F.sum("w")).alias("p"))
            cur = cell.join(p, "person").groupBy("studio").agg((F.sum(F.col("wy") - F.col("w") * F.col("p")) / F.sum("w")).alias("effect"))
            state = state.join(cur.withColumnRenamed("effect", f"r{i}"), "studio")
        state = shelf.put(state, f"rounds{k}")
        gaps = state.agg(*[F.max(F.abs(F.col(f"r{i}") - F.col(f"r{i - 1}"))) for i in range(1, CHAIN + 1)]).first()
        done = next((i + 1 for i, g in enumerate(gaps) if (g or 0.0) < tol), None)
        s = state.select("studio", F.col(f"r{done or CHAIN}").alias("effect"))
        if done:
            break
    shift = s.filter("effect <> 0").agg(F.coalesce(F.avg("effect"), F.lit(0.0)).alias("shift"))
    p = cell.join(s, "studio").groupBy("person").agg((F.sum(F.col("wy") - F.col("w") * F.col("effect")) / F.sum("w")).alias("effect"))
    one = lambda x, sign: x.crossJoin(F.broadcast(shift)).withColumn("effect", F.col("effect") + sign * F.col("shift")).drop("shift")
    return one(p, 1), one(s, -1)


def shrink_effects(panel: DataFrame, persons: DataFrame, studios: DataFrame) -> DataFrame:
    """(person, effect, shrunk, n): effects drawn to their mean by the number of observations; the strength is estimated between 2 and 50."""
    x = panel.join(persons.withColumnRenamed("effect", "pe"), "person").join(studios.withColumnRenamed("effect", "se"), "studio")
    resid = x.agg(F.avg(F.pow(F.col("y") - F.col("pe") - F.col("se"), F.lit(2.0))).alias("noise"))
    n = x.groupBy("person").agg(F.count("*").alias("n"), F.max("pe").alias("effect"))
    stat = n.agg(F.var_pop("effect").alias("var"), F.avg("effect").alias("mu"), F.avg("n").alias("bar")).crossJoin(resid)
    signal = F.greatest(F.col("var") - F.col("noise") / F.col("bar"), F.col("var") * 0.1)
    kappa = F.greatest(F.least(F.when(signal > 0, F.col("noise") / signal).otherwise(10.0), F.lit(50.0)), F.lit(2.0))
    one = n.crossJoin(F.broadcast(stat.select("mu", kappa.alias("kappa"))))  # one row
    r = F.col("n") / (F.col("n") + F.col("kappa"))
    return one.select("person", "effect", (r * F.col("effect") + (1 - r) * F.col("mu")).alias("shrunk"), "n")


def betweenness(edges: DataFrame, shelf: Shelf, sources: int | None = None) -> DataFrame:
    """(node, score): shortest-path betweenness of undirected, unweighted edges.

    All sources advance together, one join a level; then dependencies flow back
    level by level.  ``sources`` takes that many nodes (least hash) as a sample
    and scales the result; None takes all.
    """
    both = shelf.put(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "walk")
    nodes = both.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    start = nodes if sources is None or sources >= n else nodes.orderBy(F.xxhash64("node"), "node").limit(sources)
    taken = n if sources is None or sources >= n else sources
    seen = shelf.put(start.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "bfs0")
    front, levels = seen, [seen]
    while True:
        step = front.join(both.withColumnsRenamed({"src": "node", "dst": "to"}), "node").groupBy("s", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
        new = step.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(len(levels)).alias("d"), "paths")
        new = shelf.put(new, f"bfs{len(levels)}")
        if new.isEmpty():
            break
        levels.append(new)
        seen, front = seen.unionByName(new), new
    flow = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("dep"))
    total = [flow]
    for k in range(len(levels) - 2, -1, -1):
        up = flow.join(both.withColumnsRenamed({"src": "node", "dst": "to"}), "node").select("s", F.col("to").alias("node"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
        got = up.groupBy("s", "node").agg(F.sum("share").alias("share"))
        flow = levels[k].join(got, ["s", "node"], "left").select("s", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dep"))
        flow = shelf.put(flow, f"dep{k}")
        total.append(flow)
    out = total[0]
    for t in total[1:]:
        out = out.unionByName(t)
    pairs = (n - 1) * (n - 2)
    score = out.filter("s <> node").groupBy("node").agg((F.sum("dep") * (n / taken) / max(pairs, 1)).alias("score"))
    return nodes.join(score, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def principal_weights(frame: DataFrame, columns: list[str]) -> dict[str, float]:
    """Absolute loadings of the first principal component of the standardised columns, summing to 1; equal weights below ten rows.

    Only the covariance matrix, as many numbers as columns squared, comes to the driver.
    """
    z = frame.select(*columns).fillna(0.0)
    stats = z.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.avg(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in columns for b in columns]).first()
    if stats["n"] < 10:
        return dict.fromkeys(columns, 1.0 / len(columns))
    m = np.array([stats[f"m_{c}"] for c in columns])
    cov = np.array([[stats[f"{a}|{b}"] for b in columns] for a in columns]) - np.outer(m, m)
    sd = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), 1e-6)
    load = np.abs(np.linalg.eigh(cov / np.outer(sd, sd))[1][:, -1])
    return dict(zip(columns, (load / load.sum()).tolist(), strict=True))


def integrated_value(frame: DataFrame, columns: list[str], weights: dict[str, float], factor: str) -> DataFrame:
    """``frame`` with ``value``: weighted z-scores times ``factor`` (1 if null), scaled to 0..1; a missing component counts 0 before scaling."""
    stats = frame.agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"m_{c}") for c in columns], *[F.greatest(F.stddev_pop(F.coalesce(c, F.lit(0.0))), F.lit(1e-6)).alias(f"d_{c}") for c in columns])
    x = frame.crossJoin(F.broadcast(stats))  # one row
    raw = sum((weights[c] * (F.coalesce(c, F.lit(0.0)) - F.col(f"m_{c}")) / F.col(f"d_{c}") for c in columns), F.lit(0.0))
    x = x.withColumn("raw", raw * F.coalesce(factor, F.lit(1.0))).select(*frame.columns, "raw")
    ends = x.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return x.crossJoin(F.broadcast(ends)).withColumn("value", F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)).drop("raw", "lo", "hi")


def latest_rank(frame: DataFrame, key: str, value: str) -> DataFrame:
    """``frame`` with ``percentile`` of ``value``, from counts of distinct values."""
    h = frame.groupBy(value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(F.lit(1))
    h = h.select(value, (F.sum("k").over(w.orderBy(value)) / F.sum("k").over(w)).alias("percentile"))
    return frame.join(h, value)
