"""Regressions by sufficient statistics: one aggregation a step, and only small matrices on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_tail, t_tail
from ..session import Shelf

ONE = "(one)"


@dataclass(frozen=True)
class Fit:
    """Coefficients by name (``(one)`` is the intercept), standard errors, p-values and fit statistics."""

    coef: dict[str, float]
    se: dict[str, float]
    p: dict[str, float]
    n: int
    r2: float

    def expression(self) -> Column:
        """The fitted value as a column."""
        return sum((F.lit(v) if k == ONE else F.lit(v) * F.col(k) for k, v in self.coef.items()), F.lit(0.0))


def _columns(xs: list[str], intercept: bool) -> dict[str, Column]:
    return ({ONE: F.lit(1.0)} if intercept else {}) | {x: F.col(x).cast("double") for x in xs}


def _moments(df: DataFrame, cols: dict[str, Column], y: Column, w: Column) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    names = list(cols)
    aggs = [F.sum(w * cols[a] * cols[b]).alias(f"m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    aggs += [F.sum(w * cols[a] * y).alias(f"v{i}") for i, a in enumerate(names)]
    row = df.agg(*aggs, F.sum(w * y * y).alias("yy"), F.sum(w * y).alias("y"), F.sum(w).alias("w"), F.count("*").alias("n")).first()
    k = len(names)
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return m, np.array([row[f"v{i}"] or 0.0 for i in range(k)]), {c: row[c] or 0 for c in ("yy", "y", "w", "n")}


def ols(df: DataFrame, y: str, xs: list[str], weight: str | None = None, intercept: bool = True, ridge: float = 0.0, cluster: str | None = None) -> Fit:
    """Least squares of ``y`` on ``xs``; rows with a null are left out; ``cluster`` gives cluster-robust errors."""
    cols = _columns(xs, intercept)
    df = df.dropna(subset=[y, *xs, *([weight] if weight else []), *([cluster] if cluster else [])])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    yc = F.col(y).cast("double")
    m, v, s = _moments(df, cols, yc, w)
    k, n = len(cols), int(s["n"])
    inv = np.linalg.pinv(m + ridge * np.eye(k))
    b = inv @ v
    rss = max(0.0, s["yy"] - 2 * b @ v + b @ m @ b)
    tss = s["yy"] - (s["y"] ** 2 / s["w"] if intercept and s["w"] else 0.0)
    df_left = max(1, n - k)
    cov = inv * rss / df_left
    if cluster:
        fitted = sum((F.lit(float(c)) * x for c, x in zip(b, cols.values(), strict=True)), F.lit(0.0))
        score = df.groupBy(cluster).agg(*[F.sum(w * x * (yc - fitted)).alias(f"s{i}") for i, x in enumerate(cols.values())])
        row = score.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(k)]).first()
        g = max(2, row["g"])
        meat = np.array([[row[f"q{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        cov = inv @ meat @ inv * (g / (g - 1)) * ((n - 1) / df_left)
        df_left = g - 1
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    names = list(cols)
    p = {a: t_tail(abs(b[i] / se[i]), df_left) if se[i] > 0 else float("nan") for i, a in enumerate(names)}
    return Fit(dict(zip(names, b.tolist(), strict=True)), dict(zip(names, se.tolist(), strict=True)), p, n, 1 - rss / tss if tss > 0 else 0.0)


def two_stage(df: DataFrame, y: str, x: str, instrument: str, controls: list[str]) -> tuple[Fit, float]:
    """Two-stage least squares with one instrument: the second-stage fit (errors not corrected) and the first stage's F."""
    df = df.dropna(subset=[y, x, instrument, *controls])
    first = ols(df, x, [instrument, *controls])
    t = first.coef[instrument] / first.se[instrument] if first.se[instrument] else float("inf")
    return ols(df.withColumn("__fit", first.expression()), y, ["__fit", *controls]), t * t


def logistic(df: DataFrame, y: str, xs: list[str], penalty: float = 0.0, most: int = 30, tol: float = 1e-8) -> Fit:
    """Logistic regression by Newton steps; ``penalty`` is the L2 weight on all but the intercept."""
    cols = _columns(xs, True)
    df = df.dropna(subset=[y, *xs])
    k, b, cov, n = len(cols), np.zeros(len(cols)), None, 0
    ridge = penalty * np.eye(k)
    ridge[0, 0] = 0.0
    for _ in range(most):
        eta = sum((F.lit(float(c)) * x for c, x in zip(b, cols.values(), strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        d = df.withColumns({"__w": mu * (1 - mu), "__g": F.col(y).cast("double") - mu})
        m, _, s = _moments(d, cols, F.lit(0.0), F.col("__w"))
        g = np.array([v or 0.0 for v in d.agg(*[F.sum(x * F.col("__g")).alias(f"g{i}") for i, x in enumerate(cols.values())]).first()])
        n = int(s["n"])
        cov = np.linalg.pinv(m + ridge)
        step = cov @ (g - ridge @ b)
        b = b + step
        if np.max(np.abs(step)) < tol:
            break
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    names = list(cols)
    p = {a: t_tail(abs(b[i] / se[i]), 1e7) if se[i] > 0 else float("nan") for i, a in enumerate(names)}
    return Fit(dict(zip(names, b.tolist(), strict=True)), dict(zip(names, se.tolist(), strict=True)), p, n, float("nan"))


def cox(df: DataFrame, time: str, event: str, xs: list[str], most: int = 30, tol: float = 1e-8) -> Fit:
    """Proportional hazards (Breslow ties) by Newton steps.

    Risk-set sums come from a running sum over distinct times, so a step moves
    one row per distinct time, not per subject.
    """
    df = df.dropna(subset=[time, event, *xs])
    k, b = len(xs), np.zeros(len(xs))
    x = [F.col(c).cast("double") for c in xs]
    cov = np.eye(k)
    for _ in range(most):
        r = F.exp(sum((F.lit(float(c)) * v for c, v in zip(b, x, strict=True)), F.lit(0.0)))
        e = F.col(event).cast("int")
        per = df.groupBy(F.col(time).alias("t")).agg(
            F.sum(e).alias("d"), F.sum(r).alias("s"), *[F.sum(e * x[i]).alias(f"x{i}") for i in range(k)],
            *[F.sum(r * x[i]).alias(f"s{i}") for i in range(k)], *[F.sum(r * x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)],
        )
        w = Window.partitionBy(F.lit(1)).orderBy(F.col("t").desc())
        run = per.select("d", *[f"x{i}" for i in range(k)], *[F.sum(c).over(w).alias(c) for c in per.columns if c.startswith("s")]).filter("d > 0")
        mean = [F.col(f"s{i}") / F.col("s") for i in range(k)]
        row = run.agg(*[F.sum(F.col(f"x{i}") - F.col("d") * mean[i]).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("d") * (F.col(f"s{i}_{j}") / F.col("s") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        g = np.array([row[f"g{i}"] or 0.0 for i in range(k)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        cov = np.linalg.pinv(h)
        step = np.clip(cov @ g, -2, 2)
        b = b + step
        if np.max(np.abs(step)) < tol:
            break
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    p = {a: t_tail(abs(b[i] / se[i]), 1e7) if se[i] > 0 else float("nan") for i, a in enumerate(xs)}
    return Fit(dict(zip(xs, b.tolist(), strict=True)), dict(zip(xs, se.tolist(), strict=True)), p, df.count(), float("nan"))


def within(df: DataFrame, columns: list[str], groups: list[str], shelf: Shelf | None = None, tol: float = 1e-9) -> DataFrame:
    """``df`` with ``columns`` demeaned by each of ``groups``; by several in turn until no group's mean is beyond ``tol``.

    Alternate projections converge, so the rounds end; each is written to ``shelf``.
    """
    def by(df: DataFrame, g: str, more: list[str]) -> DataFrame:
        mean = df.groupBy(g).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
        left = [F.abs(F.col(f"__{c}")) for c in columns]
        moved = F.greatest(*left, *[F.col(c) for c in more]) if len(left) + len(more) > 1 else left[0]
        return df.join(mean, g).select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns if c != "__moved"], moved.alias("__moved"))

    if len(groups) == 1:
        return by(df, groups[0], []).drop("__moved")
    if shelf is None:
        raise ValueError("demeaning by several groups needs a shelf for its rounds")
    k = 0
    while True:
        for i, g in enumerate(groups):
            df = by(df, g, ["__moved"] if i else [])
        df = shelf.put(df, f"within{k}")
        shelf.drop(f"within{k - 2}")
        k += 1
        if (df.agg(F.max("__moved")).first()[0] or 0.0) < tol:
            return df.drop("__moved")


def bootstrap(df: DataFrame, statistic: dict[str, Column], replicates: int = 200, seed: int = 42, weight: str = "__w") -> DataFrame:
    """(replicate, statistics): Poisson bootstrap in one pass; ``statistic`` uses the weight column ``__w``.

    Every row gets a Poisson(1) weight per replicate from a stable hash, so the
    result doesn't depend on partitioning.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "replicate", *df.columns), 11).cast("double") * F.lit(2.0**-53)
    cuts, acc, term = [], 0.0, float(np.exp(-1))
    for i in range(8):
        acc += term
        cuts.append(acc)
        term /= i + 1
    w = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    x = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn(weight, w)
    return x.filter(F.col(weight) > 0).groupBy("replicate").agg(*[c.alias(k) for k, c in statistic.items()])


def f_test(small: Fit, large: Fit, added: int, tss: float) -> float:
    """p of the added regressors from two nested fits with total sum of squares ``tss``."""
    free = max(1, large.n - len(large.coef))
    f = ((large.r2 - small.r2) * tss / added) / max((1 - large.r2) * tss / free, 1e-300)
    return f_tail(f, added, free)
