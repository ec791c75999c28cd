"""Items that appear together (problem 2).

Exact counts of the baskets (works) two items (people) share within a stratum
(role), compared with a fitted null, and surprise with false-discovery control.

Counting.  Only items that can reach the asked support and ratio take part: an
item needs ``min_count`` baskets, and as the shared count is at most either
item's own, ``c * N >= ratio * n_a * n_b`` needs ``ratio * n <= N``.  Baskets of
ordinary size are joined with themselves by basket.  A basket with more than
``BIG`` such items isn't: its pairs are candidates only if the basket is in the
prefix of both items, where an item's baskets are ordered from small to large
and the last ``min_count - 1`` aren't in the prefix.  Two items that share
``min_count`` baskets share one of both prefixes, so no pair is lost; the big
baskets two items share are then counted from the items' lists of big baskets.
The prefix join is cut into blocks of ``BIG`` items.

Null.  Bipartite configuration model: item i is in basket j with probability
x_i y_j / (1 + x_i y_j), with x and y fitted so that every item's frequency and
every basket's size are met in expectation.  Equal degrees have equal values,
so the fit is on the distinct degrees, once a stratum; above ``EXACT`` degrees
within ``WIDTH`` of each other are one class.  Under it the shared count of two items is Poisson-binomial; the
tail P(X >= c) is computed exactly over the classes of equal basket size, by
convolution of binomials, once per distinct (n_a, n_b, c).  q-values are
Benjamini-Hochberg's over all pairs of items of the stratum.  The pairs below
the support aren't ranked, which can only make q larger.

Defined results: ids are compared trimmed and in lower case; a row without
stratum, basket or item is left out; repeats count once; ties have no
influence; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..session import Shelf

MIN_COUNT = 5
RATIO = 4.0
#: Baskets with more items than this aren't joined with themselves as a whole.
BIG = 1000
#: Groups over which the tails of one stratum are spread.
SPREAD = 16
#: Degrees up to EXACT are fitted as they are, greater ones in classes of this relative width.
EXACT, WIDTH = 512, 0.01


def incidence(rows: DataFrame, stratum: str, basket: str, item: str) -> DataFrame:
    """Distinct (s, w, p) of the rows that have all three."""
    out = rows.select(F.col(stratum).alias("s"), clean_id(basket).alias("w"), clean_id(item).alias("p"))
    return out.dropna().distinct()


def shared_counts(inc: DataFrame, shelf: Shelf, min_count: int = MIN_COUNT, ratio: float = RATIO, big: int = BIG) -> tuple[DataFrame, DataFrame]:
    """(s, a, b, c, n_a, n_b, n) of the pairs with ``c >= min_count`` and ``c * n >= ratio * n_a * n_b``, and the degree classes (s, side, degree, count)."""
    baskets = shelf.put(inc.groupBy("s", "w").agg(F.count("*").alias("k")), "baskets")
    items = shelf.put(inc.groupBy("s", "p").agg(F.count("*").cast("int").alias("n_p")), "items")
    sizes = baskets.groupBy("s").agg(F.count("*").alias("n"))
    classes = items.groupBy("s", F.lit("item").alias("side"), F.col("n_p").cast("long").alias("degree")).agg(F.count("*").alias("count")).unionByName(baskets.groupBy("s", F.lit("basket").alias("side"), F.col("k").alias("degree")).agg(F.count("*").alias("count")))
    able = shelf.put(items.join(sizes, "s").filter((F.col("n_p") >= min_count) & (F.col("n_p") * F.lit(ratio) <= F.col("n"))).select("s", "p", "n_p", "n"), "able")
    live = inc.join(able.select("s", "p"), ["s", "p"], "left_semi")
    full = live.groupBy("s", "w").agg(F.count("*").alias("k")).filter(F.col("k") > big)
    full = shelf.put(full, "full")
    if full.isEmpty():
        pairs = _pairs(live, live).groupBy("s", "a", "b").agg(F.count("*").cast("int").alias("c")).filter(F.col("c") >= min_count)
    else:
        pairs = _pairs_with_big(shelf.put(live, "live"), full, shelf, min_count, big)
    one = able.select("s", F.col("p").alias("a"), F.col("n_p").alias("n_a"), "n")
    two = able.select("s", F.col("p").alias("b"), F.col("n_p").alias("n_b"))
    out = pairs.join(one, ["s", "a"]).join(two, ["s", "b"])
    return out.filter(F.col("c") * F.col("n") >= F.lit(ratio) * F.col("n_a") * F.col("n_b")), classes


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.select("s", "w", F.col("p").alias("a")), right.select("s", "w", F.col("p").alias("b"))
    return a.join(b, ["s", "w"]).filter(F.col("a") < F.col("b")).select("s", "a", "b")


def _pairs_with_big(live: DataFrame, full: DataFrame, shelf: Shelf, min_count: int, big: int) -> DataFrame:
    """Counts where some baskets are big: ordinary baskets in full, big ones by prefixes and lists."""
    small = live.join(full.select("s", "w"), ["s", "w"], "left_anti")
    counted = _pairs(small, small).groupBy("s", "a", "b").agg(F.count("*").cast("int").alias("c"))
    large = shelf.put(live.join(full, ["s", "w"]), "large")
    # an item's big baskets come last in its order, so the last min_count - 1 baskets are big ones as far as it has them
    order = Window.partitionBy("s", "p").orderBy(F.col("k").desc(), F.col("w").desc())
    prefix = large.withColumn("from_end", F.row_number().over(order)).filter(F.col("from_end") >= min_count)
    blocks = F.ceil(F.col("k") / F.lit(big)).cast("int")
    own = F.pmod(F.xxhash64("p"), blocks).cast("int")
    a = prefix.select("s", "w", F.col("p").alias("a"), own.alias("block"))
    b = prefix.select("s", "w", F.col("p").alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    seeds = a.join(b, ["s", "w", "block"]).filter(F.col("a") < F.col("b")).select("s", "a", "b").distinct().withColumn("c", F.lit(0))
    both = counted.unionByName(seeds).groupBy("s", "a", "b").agg(F.max("c").alias("c"))
    lists = large.groupBy("s", "p").agg(F.collect_set("w").alias("ws"))
    one, two = (lists.select("s", F.col("p").alias(x), F.col("ws").alias(f"ws_{x}")) for x in "ab")
    more = F.coalesce(F.size(F.array_intersect("ws_a", "ws_b")), F.lit(0))
    out = both.join(one, ["s", "a"], "left").join(two, ["s", "b"], "left").withColumn("c", (F.col("c") + F.when(F.col("ws_a").isNotNull() & F.col("ws_b").isNotNull(), more).otherwise(0)).cast("int"))
    return out.filter(F.col("c") >= min_count).select("s", "a", "b", "c")


def fit_null(item: np.ndarray, items: np.ndarray, basket: np.ndarray, baskets: np.ndarray, steps: int = 20_000, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses of item and basket classes: degrees ``item``/``basket`` with multiplicities ``items``/``baskets``; raises if they don't settle."""
    edges = float((item * items).sum())
    x, y = item / np.sqrt(edges), basket / np.sqrt(edges)
    for _ in range(steps):
        xy = np.outer(x, y)
        nx = item / ((y * baskets) / (1 + xy)).sum(1)
        xy = np.outer(nx, y)
        ny = basket / ((nx * items)[:, None] / (1 + xy)).sum(0)
        moved = max(np.max(np.abs(nx / x - 1)), np.max(np.abs(ny / y - 1)))
        x, y = nx, ny
        if moved < eps:
            return x, y
        if not np.isfinite(moved) or max(x.max(), y.max()) > 1e12:
            break
    # a class that meets every one of the other side has no finite fitness: its expected degree must still be right
    xy = np.outer(x, y)
    off = np.abs((xy / (1 + xy) * baskets).sum(1) / item - 1).max()
    if not np.isfinite(off) or off > 1e-3:
        raise RuntimeError(f"the null of the pair counts did not settle (degrees off by {off})")
    return x, y


def degree_class(c: str) -> Column:
    """Least degree of the class of ``c``: degrees up to ``EXACT`` are classes of their own, above they are WIDTH wide."""
    step = F.floor(F.log(F.col(c) / F.lit(EXACT)) / F.lit(np.log1p(WIDTH)) + 1e-9)
    return F.when(F.col(c) <= EXACT, F.col(c).cast("long")).otherwise(F.ceil(F.lit(EXACT) * F.pow(F.lit(1 + WIDTH), step) + 1e-6).cast("long"))


def fitted_classes(classes: DataFrame) -> DataFrame:
    """(s, side, at, degree, count, fit): the null, fitted once a stratum.

    A stratum has at most EXACT + ln(greatest degree / EXACT) / WIDTH classes a side (about 2000 at a billion
    rows); a class stands for its mean degree, so a degree is off by less than WIDTH.
    """
    binned = classes.withColumn("at", degree_class("degree")).groupBy("s", "side", "at").agg(F.sum("count").alias("count"), (F.sum(F.col("degree") * F.col("count")) / F.sum("count")).alias("degree"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        i, b = g[g.side == "item"], g[g.side == "basket"]
        x, y = fit_null(i.degree.to_numpy(float), i["count"].to_numpy(float), b.degree.to_numpy(float), b["count"].to_numpy(float))
        out = pd.concat([i.assign(fit=x), b.assign(fit=y)])
        return out[["s", "side", "at", "degree", "count", "fit"]]

    return binned.groupBy("s").applyInPandas(fit, "s string, side string, at long, degree double, count long, fit double")


def tail(q: np.ndarray, m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """P(X >= c) per row; X sums Binomial(m_k, q[row, k]) over the classes k."""
    mean = (q * m).sum(1)
    upper = c > mean
    width = int(np.max(np.where(upper, c + 40, c))) + 1 if len(c) else 1
    pmf = np.zeros((len(c), width))
    pmf[:, 0] = 1.0
    for k in range(q.shape[1]):
        p, n = q[:, k], int(m[k])
        t = min(n, width - 1)
        term = np.empty((len(c), t + 1))
        term[:, 0] = np.exp(n * np.log1p(-np.minimum(p, 1 - 1e-15)))
        odds = p / np.maximum(1 - p, 1e-15)
        for i in range(1, t + 1):
            term[:, i] = term[:, i - 1] * odds * (n - i + 1) / i
        used = int(np.max(np.nonzero(term.max(0) > 1e-300)[0], initial=0)) + 1
        new = pmf * term[:, :1]
        for i in range(1, used):
            new[:, i:] += pmf[:, : width - i] * term[:, i : i + 1]
        pmf = new
    i = np.arange(width)
    above = (pmf * (i >= c[:, None])).sum(1)
    below = (pmf * (i < c[:, None])).sum(1)
    return np.clip(np.where(upper, above, 1 - below), 0, 1)


def surprise(pairs: DataFrame, classes: DataFrame, shelf: Shelf) -> DataFrame:
    """``pairs`` with expected (null mean), p_value and q_value."""
    combos = shelf.put(pairs.groupBy("s", F.least("n_a", "n_b").alias("lo"), F.greatest("n_a", "n_b").alias("hi"), "c").agg(F.count("*").alias("pairs")), "combos")
    part = F.pmod(F.xxhash64("lo", "hi"), F.lit(SPREAD)).alias("part")
    combos = combos.withColumns({"lo_at": degree_class("lo"), "hi_at": degree_class("hi")})
    spread = shelf.put(fitted_classes(classes), "null").withColumn("part", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SPREAD)])))

    def rate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["s", "lo", "hi", "c", "pairs", "expected", "p_value", "tests"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=cols)
        i, b = right[right.side == "item"].sort_values("at"), right[right.side == "basket"]
        at, x, y = i["at"].to_numpy(), i.fit.to_numpy(), b.fit.to_numpy()
        m = b["count"].to_numpy()
        n = float(i["count"].sum())
        out = left[["s", "lo", "hi", "lo_at", "hi_at", "c", "pairs"]].sort_values("c").reset_index(drop=True)
        mean, p = np.empty(len(out)), np.empty(len(out))
        for s in range(0, len(out), 2000):
            r = out.iloc[s : s + 2000]
            qa, qb = (np.outer(x[np.searchsorted(at, r[k].to_numpy())], y) for k in ("lo_at", "hi_at"))
            q = qa / (1 + qa) * qb / (1 + qb)
            mean[s : s + 2000], p[s : s + 2000] = (q * m).sum(1), tail(q, m, r.c.to_numpy())
        out["expected"], out["p_value"], out["tests"] = mean, p, n * (n - 1) / 2
        return out[cols]

    rated = combos.select("*", part).groupBy("s", "part").cogroup(spread.groupBy("s", "part")).applyInPandas(rate, "s string, lo int, hi int, c int, pairs long, expected double, p_value double, tests double")
    rated = shelf.put(rated, "rated")
    # windows over distinct (n_a, n_b, c) of a stratum, not over its pairs
    up = Window.partitionBy("s").orderBy("p_value").rangeBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("s").orderBy(F.col("p_value").desc()).rangeBetween(Window.unboundedPreceding, 0)
    rated = rated.withColumn("raw", F.col("p_value") * F.col("tests") / F.sum("pairs").over(up))
    rated = rated.withColumn("q_value", F.least(F.lit(1.0), F.min("raw").over(rest))).select("s", "lo", "hi", "c", "expected", "p_value", "q_value")
    keyed = pairs.withColumns({"lo": F.least("n_a", "n_b"), "hi": F.greatest("n_a", "n_b")})
    return keyed.join(rated, ["s", "lo", "hi", "c"], "left").drop("lo", "hi")


def together(rows: DataFrame, stratum: str, basket: str, item: str, min_count: int = MIN_COUNT, ratio: float = RATIO, big: int = BIG) -> DataFrame:
    """(s, a, b, c, n_a, n_b, n, lift, expected, p_value, q_value) of the pairs with enough support and ratio to chance."""
    shelf = Shelf(rows.sparkSession, "together")
    inc = shelf.put(incidence(rows, stratum, basket, item), "inc")
    pairs, classes = shared_counts(inc, shelf, min_count, ratio, big)
    pairs = shelf.put(pairs, "pairs")
    out = surprise(pairs, classes, shelf)
    return out.withColumn("lift", F.col("c") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
