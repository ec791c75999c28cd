"""Graph operators on blocks of neighbour lists.

A collaboration graph is built from its teams: every task turns whole works
into pairs of node numbers, and each block of nodes keeps its distinct
neighbours as one sorted list (4 bytes an entry).  Rounds are then narrow jobs:
a task reads its blocks and the state of all nodes (8 bytes a node) from the
shared folder and writes the new state of its own nodes; no edge is shuffled
again and nothing that grows with the graph comes to the driver.

Nodes are numbered in the order of their names, so ties by number are ties by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf
from .graphs import number
from .iterative import CHAIN

#: Neighbour entries of a block, about; pairs formed at once; bytes of a task's dense state.
ENTRIES, PAIRS, DENSE = 1_500_000, 4_000_000, 96_000_000

_TILE = "b long, deg binary, nbr binary, shared binary, weight binary"


def read_table(path: str, columns: list[str]):  # noqa: ANN201
    """Columns of a table of the shared folder, in a task."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    path = re.sub(r"^file:/+", "/", path)
    system, at = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return pq.read_table(at, columns=columns, filesystem=system)


def vector(path: str, column: str, dtype: str) -> np.ndarray:
    """The state of all nodes: the blocks' ``column`` in order."""
    t = read_table(path, ["b", column])
    order = np.argsort(t.column("b").to_numpy())
    parts = t.column(column).to_pylist()
    return np.concatenate([np.frombuffer(parts[k], dtype) for k in order]) if len(order) else np.zeros(0, dtype)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each count, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Tile:
    """A block of nodes: numbers ``lo`` to ``lo + len(deg) - 1`` with their neighbours."""

    lo: int
    deg: np.ndarray
    nbr: np.ndarray
    shared: np.ndarray
    weight: np.ndarray
    ptr: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.ptr = np.cumsum(self.deg) - self.deg

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.deg)), self.deg)


def _tile(size: int, b: int, deg: bytes, nbr: bytes, shared: bytes | None = None, weight: bytes | None = None) -> Tile:
    of = lambda x, t: np.frombuffer(x or b"", t)
    return Tile(int(b) * size, of(deg, "i4").astype(np.int64), of(nbr, "i4"), of(shared, "i4"), of(weight, "f8"))


@dataclass
class Blocks:
    """A graph of ``n`` nodes in blocks of ``size``; ``ids`` (node, i) names them."""

    shelf: Shelf
    ids: DataFrame
    n: int
    size: int
    tiles: DataFrame
    path: str

    def sweep(self, step: Callable[[], Callable[[Tile], dict]], schema: str) -> DataFrame:
        """One row a block: ``step()`` is called once a task, what it returns once a block."""
        size = self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = None
            for x in batches:
                f = f or step()
                for r in x.itertuples(index=False):
                    yield pd.DataFrame([{"b": r.b} | f(_tile(size, *r))])

        return self.tiles.mapInPandas(run, f"b long, {schema}")

    def streams(self) -> Iterator[Tile]:
        """All blocks one after another, in a task."""
        yield from stream(self.path, self.size)

    def nodes(self, step: Callable[[], Callable[[Tile], dict]], schema: str) -> DataFrame:
        """One row a node with its name: arrays of a block's nodes, as ``step`` gives them."""
        size = self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = None
            for x in batches:
                f = f or step()
                for r in x.itertuples(index=False):
                    t = _tile(size, *r)
                    yield pd.DataFrame({"i": np.arange(t.lo, t.lo + len(t.deg))} | f(t))

        return self.tiles.mapInPandas(run, f"i long, {schema}").join(self.ids, "i").drop("i")


def stream(path: str, size: int) -> Iterator[Tile]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    path = re.sub(r"^file:/+", "/", path)
    system, at = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet")):
        file = pq.ParquetFile(system.open_input_file(f))
        for g in range(file.num_row_groups):
            for r in file.read_row_group(g, columns=["b", "deg", "nbr"]).to_pylist():
                yield _tile(size, r["b"], r["deg"], r["nbr"])


def teams(team: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(node, i) and (leads, rest, la, ra, imp), a row a work, of (work, person, lead, a, imp).

    A pair of a work is joined if one side leads; its weight is ``a`` of both times ``imp``.
    A work of one person joins nobody; persons without any tie are no nodes.
    """
    big = team.groupBy("work").agg(F.count("*").alias("n"), F.max("lead").alias("led")).filter("n > 1 and led").select("work")
    team = shelf.put(team.join(big, "work", "left_semi"), "team")
    ids = number(team.select(F.col("person").alias("node")).distinct().orderBy("node"), shelf, "numbered")
    m = team.join(ids.toDF("person", "i"), "person")
    pick = lambda cond, c: F.collect_list(F.when(cond, F.col(c)))
    works = m.groupBy("work").agg(pick(F.col("lead"), "i").alias("leads"), pick(~F.col("lead"), "i").alias("rest"), pick(F.col("lead"), "a").alias("la"), pick(~F.col("lead"), "a").alias("ra"), F.max("imp").alias("imp"))
    return ids, shelf.put(works, "works")


def _flat(one: list, two: list, dtype: str) -> np.ndarray:
    parts = [np.asarray(p, dtype) for pair in zip(one, two, strict=True) for p in pair]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _cut(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys in order, how often each occurs, and the sums of their weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.r_[at, len(keys)])
    return keys[at], times, None if weights is None else np.add.reduceat(weights, at) if len(at) else weights


def assemble(pairs: DataFrame, shelf: Shelf, ids: DataFrame, n: int, size: int, name: str) -> Blocks:
    """Blocks of (b, u, v, w): binary lists of directed pairs and, if not null, weights; ``shared`` counts a pair's occurrences."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        b = int(x["b"].iloc[0])
        u, v = (np.concatenate([np.frombuffer(p, "i4") for p in x[c]]).astype(np.int64) for c in "uv")
        w = None if x["w"].iloc[0] is None else np.concatenate([np.frombuffer(p, "f8") for p in x["w"]])
        keys, times, w = _cut((u - b * size) * n + v, w)
        deg = np.bincount(keys // n, minlength=min(size, n - b * size)).astype("i4")
        return pd.DataFrame([{"b": b, "deg": deg.tobytes(), "nbr": (keys % n).astype("i4").tobytes(), "shared": None if w is None else times.astype("i4").tobytes(), "weight": None if w is None else w.tobytes()}])

    count = -(-n // size)
    tiles = shelf.put(pairs.repartition(max(1, count), "b").groupBy("b").applyInPandas(run, _TILE), name)
    return Blocks(shelf, ids, n, size, tiles, f"{shelf.root}/{name}")


def collaboration(team: DataFrame, shelf: Shelf, weighted: bool = False) -> Blocks:
    """The graph of teams (see ``teams``); ``shared`` and ``weight`` are kept only if ``weighted``."""
    ids, works = teams(team, shelf)
    n = ids.count()
    many = works.agg(F.sum(F.size("leads") * (F.size("leads") - 1 + 2 * F.size("rest")))).first()[0] or 0
    size = max(1, -(-n // max(1, -(-many // ENTRIES))))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            nl, nr = (x[c].map(len).to_numpy(np.int64) for c in ("leads", "rest"))
            part = np.cumsum(nl * (nl - 1 + 2 * nr)) // PAIRS
            for p in np.unique(part):
                yield from form(x[part == p], nl[part == p], nr[part == p])

    def form(x: pd.DataFrame, nl: np.ndarray, nr: np.ndarray) -> Iterator[pd.DataFrame]:
        who, k = _flat(x["leads"], x["rest"], "i8"), nl + nr
        work = np.repeat(np.arange(len(k)), k)
        first = np.cumsum(k) - k
        leads = np.arange(len(who)) - first[work] < nl[work]
        many = np.where(leads, k[work], nl[work])  # leading persons meet all, the rest the leading ones
        src, dst = np.repeat(np.arange(len(who)), many), spread(first[work], many)
        keep = who[src] != who[dst]
        src, dst = src[keep], dst[keep]
        order = np.argsort(who[src])
        src, dst = src[order], dst[order]
        u, v = who[src], who[dst]
        w = None
        if weighted:
            a = _flat(x["la"], x["ra"], "f8")
            w = a[src] * a[dst] * x["imp"].to_numpy(np.float64)[work[src]]
        b = u // size
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
        for i, j in zip(at, np.r_[at[1:], len(b)].astype(np.int64), strict=True):
            yield pd.DataFrame([{"b": b[i], "u": u[i:j].astype("i4").tobytes(), "v": v[i:j].astype("i4").tobytes(), "w": None if w is None else w[i:j].tobytes()}])

    return assemble(works.mapInPandas(pairs, "b long, u binary, v binary, w binary"), shelf, ids, n, size, "tiles")


def core_numbers(g: Blocks) -> str:
    """Path of (b, h): core numbers, by h-indices from the degrees downwards (see ``graphs.core_numbers``)."""
    at, column, k = g.path, "deg", 0
    while True:

        def step(at: str = at, column: str = column) -> Callable[[Tile], dict]:
            h = vector(at, column, "i4").copy()

            def one(t: Tile) -> dict:
                moved, own = 0, h[t.lo : t.lo + len(t.deg)]
                for _ in range(4):  # numbers only fall, in any order, so a block may go on with its own news
                    low = np.flatnonzero(np.add.reduceat((h[t.nbr] >= np.repeat(own, t.deg)).astype(np.int64), t.ptr) < own)
                    if not len(low):
                        break
                    seg = np.repeat(np.arange(len(low)), t.deg[low])
                    val = h[t.nbr[spread(t.ptr[low], t.deg[low])]]
                    val = val[np.lexsort((-val, seg))]
                    first = np.cumsum(t.deg[low]) - t.deg[low]
                    own[low] = np.add.reduceat((val > np.arange(len(val)) - first[seg]).astype(np.int64), first)
                    moved += len(low)
                return {"h": own.tobytes(), "moved": moved}

            return one

        new = g.shelf.put(g.sweep(step, "h binary, moved long"), f"core{k}")
        g.shelf.drop(f"core{k - 1}")
        at, column = f"{g.shelf.root}/core{k}", "h"
        if not new.agg(F.sum("moved")).first()[0]:
            return at
        k += 1


def commons(g: Blocks, gather: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """(b, sums): per-node sums over ties of what ``gather(deg, u, v, parts)`` says of them; parts are common neighbours and the sum of one over their degrees.

    A tie is judged in the block of its end of higher degree (ties: greater
    number), where that end's neighbours are marked and the other's list is read
    once; blocks pass by one after another.  ``gather`` gives for each name the
    values at both ends, (2, ties).
    """
    path, size, n = g.path, g.size, g.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deg, total = None, None
        for x in batches:
            if deg is None:
                deg = vector(path, "deg", "i4").astype(np.int64)
                inverse, total = 1.0 / deg, {c: np.zeros(n) for c in names}
            for r in x.itertuples(index=False):
                t = _tile(size, *r)
                rows, me = t.rows(), t.lo + t.rows()
                lower = (deg[t.nbr] < deg[me]) | ((deg[t.nbr] == deg[me]) & (t.nbr < me))
                e_row, e_other = rows[lower], t.nbr[lower].astype(np.int64)
                by = np.argsort(e_other // size, kind="stable")  # ties by the other end's block
                cut = np.searchsorted((e_other // size)[by], np.arange(-(-n // size) + 1))
                few = max(1, DENSE // 4 // n)  # nodes marked at once
                mark = np.zeros(few * n, np.uint8)
                for o in stream(path, size):
                    k = o.lo // size
                    mine = np.sort(by[cut[k] : cut[k + 1]])
                    for lo in range(0, len(t.deg), few) if len(mine) else ():
                        i, j = np.searchsorted(e_row[mine], [lo, lo + few])
                        if i == j:
                            continue
                        hi = min(lo + few, len(t.deg))
                        span = slice(t.ptr[lo], t.ptr[hi - 1] + t.deg[hi - 1])
                        flags = (rows[span] - lo) * n + t.nbr[span]
                        mark[flags] = 1
                        e = mine[i:j]
                        size_of = deg[e_other[e]]
                        for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(np.cumsum(size_of) // 1_000_000)) + 1):
                            a, b, c = e_row[e[part]], e_other[e[part]], size_of[part]
                            third = o.nbr[spread(o.ptr[b - o.lo], c)]
                            hit = mark[np.repeat((a - lo) * n, c) + third]
                            first = np.cumsum(c) - c
                            common = np.add.reduceat(hit, first, dtype=np.int64)
                            s = np.add.reduceat(hit * inverse[third], first)
                            for name, y in gather(deg, a + t.lo, b, np.stack([common.astype(float), s])).items():
                                total[name][t.lo : t.lo + len(t.deg)] += np.bincount(a, y[0], len(t.deg))
                                total[name][o.lo : o.lo + len(o.deg)] += np.bincount(b - o.lo, y[1], len(o.deg))
                        mark[flags] = 0
        for lo in range(0, n, size) if total is not None else ():
            yield pd.DataFrame([{"b": lo // size} | {c: total[c][lo : lo + size].tobytes() for c in names}])

    def add(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"b": x["b"].iloc[0]} | {c: np.sum([np.frombuffer(v, "f8") for v in x[c]], axis=0).tobytes() for c in names}])

    schema = "b long, " + ", ".join(f"{c} binary" for c in names)
    each = g.tiles.select("b", "deg", "nbr").mapInPandas(run, schema)
    return g.shelf.put(each.groupBy("b").applyInPandas(add, schema), "commons")


def louvain(g: Blocks, resolution: float = 1.0, tol: float = 1e-6) -> list[str]:
    """Paths of (b, c), one a level: the moves of ``graphs.louvain``; ``membership`` puts them together."""
    shelf, levels, level = g.shelf, [], 0
    while g.n:
        k_at = f"{shelf.root}/strength{level}"
        own = lambda: lambda t: {"c": np.arange(t.lo, t.lo + len(t.deg), dtype="i4").tobytes(), "k": (k := _sums(t, t.weight)).tobytes(), "all": float(k.sum())}
        total = shelf.put(g.sweep(own, "c binary, k binary, all double"), f"strength{level}").agg(F.sum("all")).first()[0]
        if not total:
            break

        def turn(at: str, smaller: bool, n: int = g.n, total: float = total, k_at: str = k_at) -> Callable:
            def step() -> Callable[[Tile], dict]:
                c, k = vector(at, "c", "i4").astype(np.int64), vector(k_at, "k", "f8")
                tot = np.bincount(c, k, n)

                def one(t: Tile) -> dict:
                    rows, m = t.rows(), len(t.deg)
                    mine, far = c[t.lo : t.lo + m], c[t.nbr]
                    inside = float(t.weight[far == mine[rows]].sum())
                    fits = (t.nbr != rows + t.lo) & (far <= mine[rows] if smaller else far >= mine[rows])
                    keys, _, link = _cut(np.r_[rows[fits] * n + far[fits], np.arange(m) * n + mine], np.r_[t.weight[fits], np.zeros(m)])
                    row, com = keys // n, keys % n
                    stay = com == mine[row]
                    ku = k[t.lo + row]
                    gain = np.round(link - resolution * ku * (tot[com] - np.where(stay, ku, 0.0)) / total, 9)
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    top = np.flatnonzero(gain == np.maximum.reduceat(gain, first)[row])  # ties: staying, then the smaller name
                    best = top[np.lexsort((com[top], ~stay[top], row[top]))]
                    best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
                    return {"c": com[best].astype("i4").tobytes(), "inside": inside, "tot2": float((tot * tot).sum())}

                return one

            return step

        # a turn to smaller names also tells the quality of the state it reads
        cur, best, k = k_at, None, 0
        while True:
            first = shelf.put(g.sweep(turn(cur, True), "c binary, inside double, tot2 double"), f"half{level}_{k}")
            q = first.agg(F.sum("inside").alias("i"), F.max("tot2").alias("y")).first()
            q = q["i"] / total - resolution * q["y"] / total**2
            if best is not None and q <= best[0] + tol:
                break
            best = q, cur
            shelf.put(g.sweep(turn(f"{shelf.root}/half{level}_{k}", False), "c binary, inside double, tot2 double"), f"turn{level}_{k}")
            cur, k = f"{shelf.root}/turn{level}_{k}", k + 1
        if k == 1:
            break
        levels.append(best[1])
        g, level = contract(g, best[1], level + 1), level + 1
    return levels


def _sums(t: Tile, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, t.ptr) if len(values) else np.zeros(len(t.deg))


def contract(g: Blocks, at: str, level: int) -> Blocks:
    """The graph of the communities (b, c) at ``at``, numbered in their order; ties within one become its tie with itself."""
    n = g.sweep(lambda: (lambda used: lambda t: {"n": used})(len(np.unique(vector(at, "c", "i4")))), "n long").first()["n"]
    size = -(-n // -(-g.n // g.size))

    def pairs(batches: Iterator[pd.DataFrame], old: int = g.size) -> Iterator[pd.DataFrame]:
        c = None
        for x in batches:
            if c is None:
                c = np.unique(vector(at, "c", "i4"), return_inverse=True)[1].astype(np.int64)
            for r in x.itertuples(index=False):
                t = _tile(old, *r)
                keys, _, w = _cut(c[t.lo + t.rows()] * n + c[t.nbr], t.weight)
                u, v = keys // n, keys % n
                at_ = np.flatnonzero(np.r_[True, (u // size)[1:] != (u // size)[:-1]])
                for i, j in zip(at_, np.r_[at_[1:], len(u)], strict=True):
                    yield pd.DataFrame([{"b": u[i] // size, "u": u[i:j].astype("i4").tobytes(), "v": v[i:j].astype("i4").tobytes(), "w": w[i:j].tobytes()}])

    return assemble(g.tiles.mapInPandas(pairs, "b long, u binary, v binary, w binary"), g.shelf, g.ids, n, size, f"level{level}")


def membership(levels: list[str], n: int) -> np.ndarray:
    """The least node of each node's community, in a task."""
    m = np.arange(n)
    for at in levels:
        m = np.unique(vector(at, "c", "i4"), return_inverse=True)[1][m]
    least = np.full(n, n)
    np.minimum.at(least, m, np.arange(n))
    return least[m]


def by_node(g: Blocks, blocks: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(i, columns) of (b, binary columns): of each column the type of its entries and that of the result."""
    size = g.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.to_dict("records"):
                arrays = {c: np.frombuffer(r[c], t) for c, (t, _) in columns.items()}
                k = len(next(iter(arrays.values())))
                yield pd.DataFrame({"i": np.arange(r["b"] * size, r["b"] * size + k)} | arrays)

    return blocks.select("b", *columns).mapInPandas(run, "i long, " + ", ".join(f"{c} {t}" for c, (_, t) in columns.items()))


def degrees(g: Blocks) -> DataFrame:
    """(i, k): ties of each node."""
    return by_node(g, g.tiles, {"deg": ("i4", "long")}).withColumnRenamed("deg", "k")


def components(g: Blocks) -> str:
    """Path of (b, c): the least node of each node's component, by minimum labels and pointer jumping."""
    at, k, n = None, 0, g.n
    while True:

        def step(at: str | None = at) -> Callable[[Tile], dict]:
            c = np.arange(n, dtype="i4") if at is None else vector(at, "c", "i4").copy()

            def one(t: Tile) -> dict:
                own = c[t.lo : t.lo + len(t.deg)]
                old = own.copy()
                for _ in range(4):  # labels only fall, in any order, so a block may go on with its own news
                    low = np.minimum(own, np.minimum.reduceat(c[t.nbr], t.ptr))
                    low = c[low]
                    if (low == own).all():
                        break
                    own[:] = low
                return {"c": own.tobytes(), "moved": int((own != old).sum())}

            return one

        new = g.shelf.put(g.sweep(step, "c binary, moved long"), f"label{k}")
        g.shelf.drop(f"label{k - 1}")
        at = f"{g.shelf.root}/label{k}"
        if not new.agg(F.sum("moved")).first()[0]:
            return at
        k += 1


def eigenvector(g: Blocks, tol: float = 1e-6, most: int = 1000) -> DataFrame:
    """(i, score) of the largest component, by the rounds and the end of ``graphs.eigenvector``."""
    n, shelf = g.n, g.shelf
    g = replace(g, tiles=g.tiles.withColumn("shared", F.lit(None).cast("binary")))  # not read in the rounds
    of = components(g) if n else ""
    unit = lambda z: z / np.sqrt(z @ z)

    root = shelf.root
    at = lambda k: f"{root}/eigen{k}"
    for k in range(1, most + 1) if n else ():

        def step(k: int = k) -> Callable[[Tile], dict]:
            if k == 1:
                c = vector(of, "c", "i4")
                x = (c == np.bincount(c).argmax()).astype(np.float64)  # ties: the smaller name
            else:
                x = unit(vector(at(k - 1), "z", "f8"))

            def one(t: Tile) -> dict:
                z = x[t.lo : t.lo + len(t.deg)] + _sums(t, t.weight * x[t.nbr])
                return {"z": z.tobytes(), "square": float(z @ z)}

            return one

        def change(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    a, b = (unit(vector(at(j), "z", "f8")) for j in (k - 1, k))
                    yield pd.DataFrame({"moved": [np.abs(b - a).sum()], "n": [np.count_nonzero(b)]})

        new = shelf.put(g.sweep(step, "z binary, square double"), f"eigen{k}")
        shelf.drop(f"eigen{k - 2}")
        if k % CHAIN == 0:
            r = shelf.spark.range(0, 1, 1, 1).mapInPandas(change, "moved double, n long").first()
            if r["moved"] < r["n"] * tol:
                size = new.agg(F.sum("square")).first()[0] ** 0.5
                return by_node(g, new, {"z": ("f8", "double")}).filter("z > 0").select("i", (F.col("z") / size).alias("score"))
    if n:
        raise RuntimeError(f"eigenvector scores still move after {most} rounds")
    return g.ids.select("i", F.lit(None).cast("double").alias("score"))


def most_tied(g: Blocks):  # noqa: ANN201
    """The node of most ties (ties: least name) as a row (node, i, k); None without any."""
    top = degrees(g).orderBy(F.desc("k"), "i").limit(1)
    return top.join(g.ids, "i").first()


def cores(g: Blocks) -> DataFrame:
    """(node, i, core)."""
    at = core_numbers(g)
    x = by_node(g, g.shelf.spark.read.parquet(at), {"h": ("i4", "long")}).withColumnRenamed("h", "core")
    return x.join(g.ids, "i")


def closed(g: Blocks) -> DataFrame:
    """(i, t): triangles each node is part of."""
    x = commons(g, lambda deg, u, v, p: {"t": np.stack([p[0], p[0]])}, ["t"])
    return by_node(g, x, {"t": ("f8", "double")}).select("i", F.round(F.col("t") / 2).cast("long").alias("t"))


def constraint(g: Blocks) -> DataFrame:
    """(node, k, constraint_, redundant): Burt's constraint, and the sum over ties of common neighbours less one."""

    def of(deg: np.ndarray, u: np.ndarray, v: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
        k = np.stack([deg[u], deg[v]])
        return {"constraint_": ((1.0 + p[1]) / k) ** 2, "redundant": np.stack([p[0], p[0]]) - 1.0}

    x = by_node(g, commons(g, of, ["constraint_", "redundant"]), {"constraint_": ("f8", "double"), "redundant": ("f8", "double")})
    return x.join(degrees(g), "i").join(g.ids, "i").select("node", "k", "constraint_", "redundant")


def share_of_partners(g: Blocks, marked: DataFrame) -> DataFrame:
    """(i, share): the part of a node's partners that ``marked`` (i, x) says true of."""
    size, at = g.size, f"{g.shelf.root}/marked"

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"b": x["b"].iloc[0], "x": x.sort_values("i")["x"].to_numpy(bool).tobytes()}])

    g.shelf.put(marked.withColumn("b", F.expr(f"i div {size}")).groupBy("b").applyInPandas(pack, "b long, x binary"), "marked")

    def step() -> Callable[[Tile], dict]:
        x = vector(at, "x", "?")
        return lambda t: {"share": (np.add.reduceat(x[t.nbr].astype(np.int64), t.ptr) / t.deg).tobytes()}

    return by_node(g, g.sweep(step, "share binary"), {"share": ("f8", "double")})


def communities(g: Blocks) -> DataFrame:
    """(node, community) by ``louvain``; a community is named by its least node."""
    levels, n = louvain(g), g.n

    def step() -> Callable[[Tile], dict]:
        m = membership(levels, n)
        return lambda t: {"c": m[t.lo : t.lo + len(t.deg)]}

    names = g.ids.toDF("community", "c")
    return g.shelf.put(g.nodes(step, "c long").join(names, "c").select("node", "community"), "communities")


def _distinct(rows: np.ndarray, values: np.ndarray, n: int, m: int) -> np.ndarray:
    """Distinct values of each of ``m`` rows."""
    return np.bincount(_cut(rows * n + values, None)[0] // n, minlength=m)


def bridges(g: Blocks) -> DataFrame:
    """(node, communities, score): other communities a node's ties reach, and the ties' sum of root of the smaller community times log of shared works plus one."""
    levels, n = louvain(g), g.n

    def step() -> Callable[[Tile], dict]:
        m = membership(levels, n)
        size = np.bincount(m, minlength=n)

        def one(t: Tile) -> dict:
            rows = t.rows()
            own, far = m[t.lo + rows], m[t.nbr]
            x = own != far
            part = np.sqrt(np.minimum(size[own[x]], size[far[x]])) * np.log1p(t.shared[x])
            return {"communities": _distinct(rows[x], far[x], n, len(t.deg)), "score": np.bincount(rows[x], part, len(t.deg))}

        return one

    return g.shelf.put(g.nodes(step, "communities long, score double").filter("communities > 0"), "bridges")


def spread_of_ties(g: Blocks) -> DataFrame:
    """(node, degree, communities): ties of a node and the communities among their ends."""
    levels, n = louvain(g), g.n

    def step() -> Callable[[Tile], dict]:
        m = membership(levels, n)
        return lambda t: {"degree": t.deg, "communities": _distinct(t.rows(), m[t.nbr], n, len(t.deg))}

    return g.shelf.put(g.nodes(step, "degree long, communities long"), "spread")


def betweenness(g: Blocks, sources: int | None = None) -> DataFrame:
    """(node, score) as ``iterative.betweenness``: each task takes some sources and reads the blocks once a level.

    ``sources`` takes that many nodes (least hash) as a sample and scales the result; None takes all.
    """
    n, path, size = g.n, g.path, g.size
    taken = n if sources is None or sources >= n else sources
    start = g.ids if taken == n else g.ids.orderBy(F.xxhash64("node"), "node").limit(taken)
    few = max(1, min(32, DENSE // 8 // max(1, n)))  # sources of a group: three dense states of n rows
    groups = start.select("i", F.floor((F.row_number().over(_anywhere()) - 1) / few).alias("p")).groupBy("p").agg(F.collect_list("i").alias("s"))

    def flow(state: np.ndarray, t: Tile, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), state.shape[1]))
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(t.deg[rows]) // 100_000)) + 1):
            r = rows[part]
            if len(r):
                out[part] = np.add.reduceat(state[t.nbr[spread(t.ptr[r], t.deg[r])]], np.cumsum(t.deg[r]) - t.deg[r], axis=0)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in batches:
            for s in x["s"]:
                s = np.asarray(s, np.int64)
                col = np.arange(len(s))
                d, paths = np.full((n, len(s)), -1, np.int16), np.zeros((n, len(s)))
                d[s, col], paths[s, col] = 0, 1.0
                level = 0
                while True:
                    front, met = np.where(d == level, paths, 0.0), False
                    for t in stream(path, size):
                        rows = np.flatnonzero((d[t.lo : t.lo + len(t.deg)] < 0).any(axis=1))
                        got = flow(front, t, rows)
                        at = t.lo + rows
                        new = (d[at] < 0) & (got > 0)
                        met |= bool(new.any())
                        paths[at] += np.where(new, got, 0.0)
                        d[at] = np.where(new, level + 1, d[at])
                    if not met:
                        break
                    level += 1
                dep = np.zeros((n, len(s)))
                for k in range(level - 1, -1, -1):
                    back = np.where(d == k + 1, (1.0 + dep) / np.where(paths > 0, paths, 1.0), 0.0)
                    for t in stream(path, size):
                        rows = np.flatnonzero((d[t.lo : t.lo + len(t.deg)] == k).any(axis=1))
                        at = t.lo + rows
                        dep[at] += np.where(d[at] == k, paths[at] * flow(back, t, rows), 0.0)
                dep[s, col] = 0.0
                total = dep.sum(axis=1) + (0.0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(n), "dep": total})

    tasks = min(-(-taken // few), max(8, g.ids.sparkSession.sparkContext.defaultParallelism))
    each = groups.repartition(tasks, "p").mapInPandas(run, "i long, dep double").groupBy("i").agg(F.sum("dep").alias("dep"))
    return each.join(g.ids, "i").select("node", (F.col("dep") * (n / max(1, taken)) / max((n - 1) * (n - 2), 1)).alias("score"))


def _anywhere():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy("i")


def paths_from(g: Blocks, source: int, targets: DataFrame, most: int | None = None) -> DataFrame:
    """(target, hops, paths, path) of the nodes ``targets`` (target) that paths from node number ``source`` reach, within ``most`` steps if given.

    Defined as ``graphs.shortest_paths``: ``path`` (array) is the least shortest path in order of nodes.  One task walks
    over the blocks once a level and holds five states of all nodes; numbers of paths beyond a long are an error.
    """
    n, path, size = g.n, g.path, g.size

    def walk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hops, paths, before, rank = np.full(n, -1, np.int32), np.zeros(n, np.int64), np.full(n, -1), np.full(n, n)
        hops[source], paths[source], rank[source] = 0, 1, 0
        place, k = np.array([source]), 0  # nodes of the last level in order of their least paths
        while most is None or k < most:
            k += 1
            found = []
            for t in stream(path, size):
                rows = np.flatnonzero(hops[t.lo : t.lo + len(t.deg)] < 0)
                if not len(rows):
                    continue
                far = t.nbr[spread(t.ptr[rows], t.deg[rows])]
                first = np.cumsum(t.deg[rows]) - t.deg[rows]
                last = hops[far] == k - 1
                low = np.minimum.reduceat(np.where(last, rank[far], n), first)
                new = low < n
                at = t.lo + rows[new]
                ways = np.where(last, paths[far], 0)
                if (np.add.reduceat(ways.astype(np.float64), first) > 9.2e18).any():
                    raise OverflowError(f"more shortest paths of {k} steps than a long can count")
                paths[at] = np.add.reduceat(ways, first)[new]
                before[at] = place[low[new]]
                found.append((at, low[new]))
            at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            if not len(at):
                break
            low = np.concatenate([f[1] for f in found])
            place = at[np.lexsort((at, low))]
            hops[at], rank[place] = k, np.arange(len(place))
        return hops, paths, before

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None
        for x in batches:
            if not len(x):
                continue
            hops, paths, before = known = known or walk()
            i = x["i"].to_numpy(np.int64)
            i = i[hops[i] >= 0]
            for k in np.unique(hops[i]):
                at = i[hops[i] == k]
                ways = [at]
                for _ in range(k):
                    ways.append(before[ways[-1]])
                yield pd.DataFrame({"i": at, "hops": hops[at], "paths": paths[at], "way": list(np.stack(ways[::-1], axis=1))})

    asked = targets.join(g.ids.withColumnRenamed("node", "target"), "target").select("i").distinct().coalesce(1)
    got = g.shelf.put(asked.mapInPandas(run, "i long, hops int, paths long, way array<long>"), "paths")
    step = got.select("i", F.posexplode("way").alias("k", "j")).join(g.ids.toDF("name", "j"), "j")
    names = step.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("p")).select("i", F.col("p.name").alias("path"))
    return got.join(names, "i").join(g.ids.withColumnRenamed("node", "target"), "i").select("target", "hops", "paths", "path")


def two_step_reach(team: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, n_reached): distinct other nodes within two steps, from teams (see ``teams``) without any tie.

    What a leading member of a work sees in two steps there is the union of all
    members' neighbours, what another sees that of the leading ones; so unions
    are taken a work, not a tie.  A task holds the members of all works and, as
    bits, a slice of the nodes reached.
    """
    ids, works = teams(team, shelf)
    n, path = ids.count(), f"{shelf.root}/works"
    bits = max(1, DENSE * 8 // 64 // max(1, n + 2 * works.count())) * 64
    slices = -(-n // bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = None
        for x in batches:
            if seen is None and len(x):
                seen = np.zeros(n, np.int64)
                w = read_table(path, ["leads", "rest"])
                leads, rest = (w.column(c).combine_chunks() for c in ("leads", "rest"))
                nl, nr = (np.diff(c.offsets.to_numpy()) for c in (leads, rest))
                k = (nl + nr).astype(np.int64)
                first = np.cumsum(k) - k
                who = np.empty(k.sum(), np.int32)  # leading members of a work first
                who[spread(first, nl)], who[spread(first + nl, nr)] = leads.flatten().to_numpy(), rest.flatten().to_numpy()
                work = np.repeat(np.arange(len(k), dtype=np.int32), k)
                lead = np.arange(len(who)) - first[work] < nl[work]
                mine = np.argsort(who, kind="stable")  # the same rows by member
                count = np.bincount(who, minlength=n)
                from_ = np.cumsum(count) - count
                # sources of a member: row 2 w is all of work w, row 2 w + 1 its leading members
                source = 2 * work[mine].astype(np.int64) + ~lead[mine]
            for s in x["id"]:
                lo, words = int(s) * bits, bits // 64
                here = np.flatnonzero((who >= lo) & (who < lo + bits))
                word, bit = (who[here] - lo) // 64, np.uint64(1) << ((who[here] - lo) % 64).astype(np.uint64)
                of = np.zeros((2 * len(k), words), np.uint64)
                np.bitwise_or.at(of, (2 * work[here], word), bit)
                np.bitwise_or.at(of, (2 * work[here][lead[here]] + 1, word[lead[here]]), bit[lead[here]])
                near = _either(of, source, from_, count)
                me = np.arange(lo, min(lo + bits, n))
                near[me, (me - lo) // 64] &= ~(np.uint64(1) << ((me - lo) % 64).astype(np.uint64))
                of[0::2] = _either(near, who, first, k)
                of[1::2] = _either(near, who, first, nl)
                near |= _either(of, source, from_, count)
                seen += np.bitwise_count(near).sum(axis=1, dtype=np.int64)
        if seen is not None:
            yield pd.DataFrame({"i": np.arange(n), "k": seen})

    spark = shelf.spark
    tasks = max(1, min(slices, spark.sparkContext.defaultParallelism))
    each = spark.range(0, slices, 1, tasks).mapInPandas(run, "i long, k long").groupBy("i").agg((F.sum("k") - 1).alias("n_reached"))  # every node reaches itself in two steps
    return each.join(ids, "i").select("node", "n_reached")


def _either(bits: np.ndarray, rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each (first, count) the union of the rows ``bits[rows[first]]`` and on."""
    out = np.zeros((len(first), bits.shape[1]), np.uint64)
    step = max(1, 32_000_000 // 8 // bits.shape[1])
    some = np.flatnonzero(count)
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(count[some]) // step)) + 1):
        if len(part):
            c = count[part]
            out[part] = np.bitwise_or.reduceat(bits[rows[spread(first[part], c)]], np.cumsum(c) - c, axis=0)
    return out
