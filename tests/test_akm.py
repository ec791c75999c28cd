"""The two-way effects and what follows them, against a plain version."""

from __future__ import annotations

import numpy as np
import pytest

from reelspark.operators import akm
from reelspark.session import Shelf

PANEL = "person string, studio string, y double, w double, x double, z double"


def make(rng, n, moves):
    pe, se = rng.normal(size=n), rng.normal(size=5)
    rows = []
    for i in range(n):
        home = rng.integers(5)
        for t in range(2 + i % 9):
            j = rng.integers(5) if i < moves * n else home
            x, z = rng.random() * 10, rng.random()
            rows.append((f"p{i:03d}", f"s{j}", float(pe[i] + se[j] + 0.3 * x - z + rng.normal() * 0.2), float(0.5 + rng.random()), float(x), float(z)))
    return rows


def plain(rows, counts):
    p = sorted({r[0] for r in rows})
    s = sorted({r[1] for r in rows})
    pi, si = np.array([p.index(r[0]) for r in rows]), np.array([s.index(r[1]) for r in rows])
    y, w, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([[1.0, r[4], r[5]] for r in rows])
    b = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * y))
    y = y - x @ b
    moves = np.array([len({r[1] for r in rows if r[0] == a}) > 1 for a in p])
    mean = lambda v, i, n: np.bincount(i, w * v, n) / np.bincount(i, w, n)
    fe, se = mean(y, pi, len(p)), np.zeros(len(s))
    if moves.mean() >= 0.1:
        for _ in range(500):
            fe = mean(y - se[si], pi, len(p))
            se = mean(y - fe[pi], si, len(s))
        shift = se.mean()
        fe, se = mean(y - se[si], pi, len(p)) + shift, se - shift
    raw = fe.copy()
    n = np.bincount(pi)
    noise, var = np.mean((y - fe[pi] - se[si]) ** 2), fe.var()
    signal = max(var - noise / n.mean(), 0.1 * var)
    k = min(max(noise / signal if signal > 0 else 10, 2), 50)
    fe = n / (n + k) * fe + k / (n + k) * fe.mean()
    lc = np.log1p(counts)
    slope = np.cov(lc, fe, bias=True)[0, 1] / lc.var()
    res = fe - fe.mean() - slope * (lc - lc.mean())
    t = slope / np.sqrt((res**2).sum() / (len(p) - 2) / (len(p) * lc.var()))
    if slope < 0 and t < -1.7:
        fe = fe - slope * (lc - lc.mean())
    cell = np.zeros((len(p), len(s)))
    np.add.at(cell, (pi, si), w)
    main = cell.argmax(1)
    rcs = cell.max(1) / cell.sum(0)[main] * np.bincount(main, minlength=len(s))[main]
    f = se[main]
    sl = lambda m: np.cov(f[m], fe[m], bias=True)[0, 1] / f[m].var() if f[m].std() > 1e-10 else 0.0
    if moves.sum() >= 20 and (~moves).sum() >= 20:
        alpha = max(0.0, sl(moves) - sl(~moves))
        if alpha >= 0.005:
            most = 3 * fe.std()
            fe = fe + np.clip(alpha * rcs * f, -most, most)
    return dict(zip(p, zip(raw, fe, strict=True), strict=True)), dict(zip(s, se, strict=True))


@pytest.mark.parametrize("moves", [0.6, 0.02])
def test_against_plain(spark, moves):
    rng = np.random.default_rng(11)
    rows = make(rng, 70, moves)
    people = sorted({r[0] for r in rows})
    counts = [3 + 5 * (i % 9) for i in range(len(people))]
    df = spark.createDataFrame(rows, PANEL)
    movers = df.groupBy("person").agg({"studio": "count"}).select("person").join(df.select("person", "studio").distinct().groupBy("person").count().filter("count > 1").select("person"), "person")
    got = akm.estimate(df, ["x", "z"], movers, spark.createDataFrame(list(zip(people, counts, strict=True)), "person string, n long"), Shelf(spark, "t"))
    want, studios = plain(rows, np.array(counts))
    for r in got.persons.collect():
        assert abs(r.raw - want[r.person][0]) < 1e-5 and abs(r.effect - want[r.person][1]) < 1e-5
    assert all(abs(r.effect - studios[r.studio]) < 1e-5 for r in got.studios.collect())
