"""Two-way fixed effects with controls, and what follows them: shrinkage, count debiasing, redistribution.

A panel has one row an observation: person, studio, y, w and the controls.
Only one-row aggregates come to the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_tail
from ..session import Shelf
from .iterative import shrink_effects, two_way_effects

# Shares and counts below which a step is left out.
LEAST_MOVERS = 0.10
DEBIAS_PERSONS, DEBIAS_P = 20, 0.05
MOVE_PERSONS, MOVE_ROWS, MOVE_GROUP, MOVE_ALPHA, MOVE_CLIP = 30, 100, 20, 0.005, 3.0


def partial_out(panel: DataFrame, controls: list[str]) -> DataFrame:
    """``panel`` with ``y`` less its weighted regression on the controls and a constant, from one aggregate."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in controls]]
    k = len(x)
    sums = [F.sum(F.col("w") * x[i] * x[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("w") * x[i] * F.col("y")).alias(f"v{i}") for i in range(k)]
    row = panel.agg(*sums).first()
    if row["m0_0"] is None:
        return panel
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.linalg.lstsq(m, np.array([row[f"v{i}"] for i in range(k)]), rcond=None)[0]
    return panel.withColumn("y", F.col("y") - sum((F.lit(float(c)) * v for c, v in zip(b, x, strict=True)), F.lit(0.0)))


def person_effects_only(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted means by person and no studio effects: where too few persons move, studios aren't identified."""
    p = panel.filter("w > 0").groupBy("person").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("effect"))
    return p, panel.groupBy("studio").agg(F.lit(0.0).alias("effect"))


def debias_by_count(persons: DataFrame, counts: DataFrame) -> DataFrame:
    """``persons`` (person, effect) without the slope of the effect on the log of the person's count, if it is surely negative."""
    x = persons.join(counts.select("person", F.col("n").alias("__n")), "person", "left").withColumn("__x", F.when(F.col("__n") > 0, F.log1p("__n")))
    a = x.filter("__x is not null").agg(F.count("*").alias("n"), F.avg("__x").alias("mx"), F.avg("effect").alias("my"), F.var_pop("__x").alias("vx"), F.var_pop("effect").alias("vy"), F.covar_pop("__x", "effect").alias("c")).first()
    if a["n"] < DEBIAS_PERSONS or not a["vx"]:
        return persons
    slope = a["c"] / a["vx"]
    rss = a["n"] * max(a["vy"] - slope * a["c"], 0.0)
    se = np.sqrt(rss / (a["n"] - 2) / (a["n"] * a["vx"]))
    p = t_tail(abs(slope / se), a["n"] - 2) / 2 if se > 1e-12 else 1.0  # one side of a two-sided tail
    if slope >= 0 or p > DEBIAS_P:
        return persons
    return x.withColumn("effect", F.coalesce(F.col("effect") - F.lit(float(slope)) * (F.col("__x") - F.lit(float(a["mx"]))), F.col("effect"))).drop("__n", "__x")


def redistribute(persons: DataFrame, studios: DataFrame, panel: DataFrame, movers: DataFrame, shelf: Shelf) -> DataFrame:
    """``persons`` with the part of their main studio's effect that stayers lose to it, by relative share of its weight."""
    cell = panel.groupBy("person", "studio").agg(F.sum("w").alias("w"))
    main = cell.groupBy("person").agg(F.max_by(F.struct("studio", "w"), F.struct("w", "studio")).alias("m")).select("person", "m.studio", F.col("m.w").alias("own"))
    total = cell.groupBy("studio").agg(F.sum("w").alias("total"))
    heads = main.groupBy("studio").agg(F.count("*").alias("heads"))
    x = persons.join(main, "person").join(total, "studio").join(heads, "studio").join(studios.select("studio", F.col("effect").alias("se")), "studio").join(movers.select("person", F.lit(True).alias("moves")), "person", "left")
    share = F.when(F.col("total") > 0, F.col("own") / F.col("total")).otherwise(0.0)
    x = shelf.put(x.select("person", "effect", "se", F.coalesce("moves", F.lit(False)).alias("moves"), (share * F.col("heads")).alias("rcs")), "redistribution")
    on = lambda moves: x.filter((F.col("rcs") > 0) & (F.col("moves") == moves)).agg(F.count("*").alias("n"), F.covar_pop("se", "effect").alias("c"), F.var_pop("se").alias("v")).first()
    m, s = on(True), on(False)
    rows = panel.count()
    slope = lambda r: r["c"] / r["v"] if r["v"] and r["v"] >= 1e-20 else 0.0
    if m["n"] + s["n"] < MOVE_PERSONS or rows < MOVE_ROWS or m["n"] < MOVE_GROUP or s["n"] < MOVE_GROUP:
        return persons
    alpha = max(0.0, slope(m) - slope(s))
    if alpha < MOVE_ALPHA:
        return persons
    spread = x.filter("rcs > 0").agg(F.stddev_pop("effect")).first()[0]
    most = MOVE_CLIP * spread if spread else 1.0
    add = F.greatest(F.least(F.lit(alpha) * F.col("rcs") * F.col("se"), F.lit(most)), F.lit(-most))
    return persons.join(x.select("person", add.alias("add")), "person", "left").withColumn("effect", F.col("effect") + F.coalesce("add", F.lit(0.0))).drop("add")


class Effects(NamedTuple):
    persons: DataFrame  # person, raw, effect, n
    studios: DataFrame  # studio, effect


def estimate(panel: DataFrame, controls: list[str], movers: DataFrame, counts: DataFrame, shelf: Shelf) -> Effects:
    """All steps on the observations (person, studio, y, w, controls) of one connected set.

    ``movers`` (person) and ``counts`` (person, n) describe the persons of the set.
    """
    obs = shelf.put(partial_out(panel, controls), "residual")
    n, moving = (obs.select("person").distinct().join(x, "person", "left_semi").count() if x is not None else obs.select("person").distinct().count() for x in (None, movers))
    pair = two_way_effects(obs, shelf) if n and moving / n >= LEAST_MOVERS else person_effects_only(obs)
    persons, studios = shelf.put(pair[0], "person_effect"), shelf.put(pair[1], "studio_effect")
    shrunk = shelf.put(shrink_effects(obs, persons, studios), "shrunk")
    final = debias_by_count(shrunk.select("person", F.col("shrunk").alias("effect")), counts)
    final = redistribute(shelf.put(final, "debiased"), studios, obs, movers, shelf)
    return Effects(shelf.put(final.join(shrunk.select("person", F.col("effect").alias("raw"), "n"), "person").select("person", "raw", "effect", "n"), "final"), studios)
