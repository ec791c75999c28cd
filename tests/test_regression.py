"""Regressions and tails against numpy and known values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import tails
from reelspark.operators import regression as rg


def test_tails():
    assert abs(tails.t_tail(2.0, 10) - 0.0733880) < 1e-6 and abs(tails.t_tail(1.96, 1e7) - 0.0499958) < 1e-5
    assert abs(tails.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(tails.chi2_tail(18.307, 10) - 0.05) < 1e-5
    assert abs(tails.f_tail(4.9646, 1, 10) - 0.05) < 1e-5 and abs(tails.normal_quantile(0.975) - 1.959964) < 1e-6
    assert abs(tails.e_value(2.0) - 3.414214) < 1e-6 and tails.e_value(0.5) == tails.e_value(2.0)
    assert tails.joint_leads([(2.0, 1.0), (0.0, 1.0)])[0] == 4.0


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(5)
    n = 200
    z, a, b, g = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n), rng.integers(0, 20, n)
    x = 0.8 * z + rng.normal(size=n)
    y = 1 + 2 * x - a + rng.normal(size=n) * 0.5 + g * 0.1
    c = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + a - 0.7 * b)))).astype(int)
    t = np.ceil(rng.exponential(np.exp(-0.6 * a)) * 10).astype(int)
    e = rng.random(n) < 0.8
    rows = [(float(y[i]), float(x[i]), float(a[i]), float(b[i]), float(z[i]), int(g[i]), int(c[i]), int(t[i]), bool(e[i])) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, *rows[0][1:])], "y double, x double, a double, b double, z double, g int, c int, t int, e boolean")
    return df, (y, x, a, b, z, g, c, t, e)


def test_ols(data):
    df, (y, x, a, *_, g, _c, _t, _e) = data
    m = np.column_stack([np.ones(len(y)), x, a])
    beta, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    fit = rg.ols(df, "y", ["x", "a"])
    assert np.allclose(list(fit.coef.values()), beta, atol=1e-9) and fit.n == len(y)
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rss[0] / (len(y) - 3))
    assert np.allclose(list(fit.se.values()), se, atol=1e-9)
    r = y - m @ beta
    meat = sum(np.outer(s, s) for s in (m[g == k].T @ r[g == k] for k in set(g)))
    inv, q = np.linalg.inv(m.T @ m), len(set(g))
    cov = inv @ meat @ inv * q / (q - 1) * (len(y) - 1) / (len(y) - 3)
    assert np.allclose(list(rg.ols(df, "y", ["x", "a"], cluster="g").se.values()), np.sqrt(np.diag(cov)), atol=1e-9)
    small = rg.ols(df, "y", ["a"])
    assert rg.f_test(small, fit, 1, float(((y - y.mean()) ** 2).sum())) < 1e-6


def test_two_stage(data):
    df, (y, x, a, b, z, *_) = data
    fit, f = rg.two_stage(df, "y", "x", "z", ["a"])
    m = np.column_stack([np.ones(len(y)), z, a])
    xh = m @ np.linalg.lstsq(m, x, rcond=None)[0]
    want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), xh, a]), y, rcond=None)[0]
    assert np.allclose(list(fit.coef.values()), want, atol=1e-8) and f > 10


def test_logistic_and_cox(data):
    df, (_y, _x, a, b, _z, _g, c, t, e) = data
    fit = rg.logistic(df.filter("y is not null"), "c", ["a", "b"])
    m = np.column_stack([np.ones(len(a)), a, b])
    mu = 1 / (1 + np.exp(-m @ np.array(list(fit.coef.values()))))
    assert np.max(np.abs(m.T @ (c - mu))) < 1e-6 and fit.coef["a"] > 0 > fit.coef["b"]
    hz = rg.cox(df.filter("y is not null"), "t", "e", ["a"])
    r = np.exp(hz.coef["a"] * a)
    grad = sum(a[i] - (r * a)[t >= t[i]].sum() / r[t >= t[i]].sum() for i in range(len(a)) if e[i])
    assert abs(grad) < 1e-5 and hz.coef["a"] > 0


def test_within_two_groups_ends_when_no_mean_is_left(spark):
    from reelspark.session import Shelf

    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(9)), int(rng.integers(5)), float(rng.normal())) for _ in range(120)]  # unbalanced
    rows = [(a, b, y + a - 2 * b) for a, b, y in rows]
    got = rg.within(spark.createDataFrame(rows, "a int, b int, y double"), ["y"], ["a", "b"], Shelf(spark, "t"), tol=1e-8)
    for g in "ab":
        assert all(abs(r.m) < 1e-7 for r in got.groupBy(g).agg(F.avg("y").alias("m")).collect())
    with pytest.raises(ValueError):
        rg.within(got, ["y"], ["a", "b"])


def test_within_and_bootstrap(data, spark):
    df, (y, *_, g, _c, _t, _e) = data
    d = rg.within(df.filter("y is not null").select("y", "g"), ["y"], ["g"])
    assert all(abs(r.m) < 1e-9 for r in d.groupBy("g").agg(F.avg("y").alias("m")).collect())
    b = rg.bootstrap(df.filter("y is not null").select("y"), {"mean": F.sum(F.col("y") * F.col("__w")) / F.sum("__w")}, 200)
    got = np.array([r["mean"] for r in b.collect()])
    assert len(got) == 200 and abs(got.mean() - y.mean()) < 0.1 and abs(got.std() - y.std() / np.sqrt(len(y))) < 0.06
