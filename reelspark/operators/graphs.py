"""Graph operators over whole graphs: triangles, reach, cores, communities, eigenvectors, paths.

Nodes are numbered in order of degree, so a pair packs into one long and an
edge points from the lower to the higher degree; a node then has at most the
root of twice the edges as out-neighbours, hub or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Shelf
from .iterative import CHAIN

#: Ids fit below this; a pair is ``first * ID_SPACE + second``.
ID_SPACE = 2**31


def both_directions(edges: DataFrame, *more: str) -> DataFrame:
    """(u, v, more) of undirected edges (src, dst, more) in both directions."""
    ends = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.select(F.explode(ends).alias("e"), *more).select("e.*", *more)


def pair_key(a: Column | str, b: Column | str) -> Column:
    """One long for a pair of ids."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a * F.lit(ID_SPACE) + b


def number(nodes: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """``nodes`` with ``i``, 0 to n - 1 in the order of the frame's partitions: their sizes alone give the offsets."""
    raw = shelf.put(nodes.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}), f"{name}_raw")
    sizes = raw.groupBy("__part").agg(F.count("*").alias("n"))  # one row a partition
    before = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return shelf.put(raw.join(starts, "__part").withColumn("i", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start"), name)


def oriented(edges: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(node, k, i) in order of degree ``k``, and (lo, hi, k_lo, k_hi) of distinct edges (src, dst), lo < hi."""
    e = shelf.put(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "simple")
    deg = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    ids = number(deg.orderBy("k", "node"), shelf, "numbered")
    x = e.join(ids.toDF("src", "ka", "a"), "src").join(ids.toDF("dst", "kb", "b"), "dst")
    up = F.col("a") < F.col("b")
    return ids, shelf.put(x.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.when(up, F.col("ka")).otherwise(F.col("kb")).alias("k_lo"), F.when(up, F.col("kb")).otherwise(F.col("ka")).alias("k_hi")), "oriented")


def triangles(edge: DataFrame) -> DataFrame:
    """(a, b, c, k_a, k_b, k_c) of each triangle of ``oriented`` edges once, a < b < c.

    Both joins hash the edges, the smaller side of each, partition by partition.
    """
    one = edge.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("k_lo").alias("k_a"), F.col("k_hi").alias("k_b"))
    two = edge.select(F.col("lo").alias("a"), F.col("hi").alias("c"), F.col("k_hi").alias("k_c"))
    wedge = one.join(two.hint("shuffle_hash"), "a").filter("b < c").withColumn("key", pair_key("b", "c"))
    return wedge.join(edge.select(pair_key("lo", "hi").alias("key")).hint("shuffle_hash"), "key", "left_semi").drop("key")


def edge_triangles(edge: DataFrame) -> DataFrame:
    """(lo, hi, common, s): of edges in a triangle, the common neighbours and the sum of one over their degrees."""
    third = lambda x, y, z: F.struct(pair_key(x, y).alias("key"), (F.lit(1.0) / F.col(f"k_{z}")).alias("s"))
    t = triangles(edge).select(F.explode(F.array(third("a", "b", "c"), third("a", "c", "b"), third("b", "c", "a"))).alias("t"))
    g = t.groupBy("t.key").agg(F.count("*").alias("common"), F.sum("t.s").alias("s"))
    return g.select(F.expr(f"key div {ID_SPACE}L").alias("lo"), F.expr(f"key % {ID_SPACE}L").alias("hi"), "common", "s")


def two_step_reach(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, n_reached): distinct other nodes within two steps.

    A node's neighbours are bitmaps of 32768 ids each, and a node's reach is the
    union of its neighbours' bitmaps: one row an edge and bitmap instead of one
    a path of two steps, united before the shuffle.
    """
    ids, edge = oriented(edges, shelf)
    both = both_directions(edge.select(F.col("lo").alias("src"), F.col("hi").alias("dst")))
    near = both.groupBy("u", F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    near = shelf.put(near, "bitmaps")
    far = both.join(near.withColumnRenamed("u", "v"), "v").select("u", "bucket", "bits")
    all_bits = near.unionByName(far).groupBy("u", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    # every node with a neighbour reaches itself in two steps
    n = all_bits.groupBy("u").agg((F.sum(F.bitmap_count("bits")) - 1).alias("n_reached"))
    return n.join(ids.select(F.col("i").alias("u"), "node"), "u").select("node", "n_reached")


def core_numbers(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, core) of undirected edges.

    From its degree downwards, a node's number is the greatest h such that h
    neighbours have h or more; the fixed point is the core number.  So the
    rounds follow the graph's depth, not its number of cores.  A node's
    neighbours are counted by value, so a hub is as many rows as values.
    """
    ids, edge = oriented(edges, shelf)
    both = shelf.put(both_directions(edge.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))), "both")
    cur = ids.select(F.col("i").alias("u"), F.col("k").alias("h"))
    down = Window.partitionBy("u").orderBy(F.desc("h"))
    done, k = False, 0
    while not done:
        for _ in range(CHAIN):
            old = cur
            seen = both.join(cur.withColumnRenamed("u", "v"), "v").groupBy("u", "h").agg(F.count("*").alias("m"))
            cur = seen.withColumn("m", F.sum("m").over(down)).groupBy("u").agg(F.max(F.least("h", "m")).alias("h"))
        cur = shelf.put(cur.join(old.withColumnRenamed("h", "old"), "u"), f"core{k}")
        done = cur.filter("h <> old").isEmpty()
        cur = cur.select("u", "h")
        shelf.drop(f"core{k - 1}")
        k += 1
    return cur.join(ids.select(F.col("i").alias("u"), "node"), "u").select("node", F.col("h").alias("core"))


def louvain(edges: DataFrame, shelf: Shelf, resolution: float = 1.0, tol: float = 1e-6) -> DataFrame:
    """(node, community) by greedy modularity over levels; a community is named by its least node.

    All nodes of a level move at once: to the neighbouring community of most
    gain (ties: smaller name), in turn only to smaller and only to greater
    names, so two nodes can't swap.  A level ends when a turn of both adds less
    than ``tol`` to the modularity (what it did then is undone), and the
    communities become the nodes of the next level until none moves.
    """
    g = both_directions(edges, "weight").groupBy("u", "v").agg(F.sum("weight").alias("w"))
    g = shelf.put(g, "level0")
    total = g.agg(F.sum("w")).first()[0]
    member = g.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct()
    if not total:
        return member
    level = 0
    while True:
        k = shelf.put(g.groupBy("u").agg(F.sum("w").alias("k")), f"degree{level}")
        cur = start = k.select("u", F.col("u").alias("c"), "k")

        def quality(com: DataFrame, g: DataFrame = g) -> float:
            inside = g.join(com.select("u", F.col("c").alias("cu")), "u").join(com.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").filter("cu = cv").agg(F.sum("w").alias("x")).withColumn("y", F.lit(None).cast("double"))
            tot = com.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("y")).select(F.lit(None).cast("double").alias("x"), "y")
            r = inside.unionByName(tot).agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
            return (r["x"] or 0.0) / total - resolution * r["y"] / total**2

        def turn(com: DataFrame, smaller: bool, g: DataFrame = g) -> DataFrame:
            link = g.filter("u <> v").join(com.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("l"))
            link = link.unionByName(com.select("u", "c", F.lit(0.0).alias("l"))).groupBy("u", "c").agg(F.sum("l").alias("l"))
            tot = com.groupBy("c").agg(F.sum("k").alias("t"))
            x = link.join(com.select("u", F.col("c").alias("own"), "k"), "u").join(tot, "c")
            gain = F.round(F.col("l") - resolution * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total, 9)
            fits = F.col("c") <= F.col("own") if smaller else F.col("c") >= F.col("own")
            best = F.min(F.struct((-gain).alias("g"), (F.col("c") != F.col("own")).alias("moved"), "c"))
            return x.filter(fits).groupBy("u", "k").agg(best.alias("b")).select("u", F.col("b.c").alias("c"), "k")

        best, n = quality(start), 0
        while True:
            new = shelf.put(turn(turn(cur, True), False), f"turn{level}_{n}")
            q = quality(new)
            if q <= best + tol:
                break
            cur, best, n = new, q, n + 1
        if n == 0:
            break
        move = cur.select("u", "c")
        member = shelf.put(member.join(move.withColumnsRenamed({"u": "community"}), "community").select("node", F.col("c").alias("community")), f"member{level}")
        nxt = g.join(move.withColumnRenamed("c", "cu"), "u").join(move.toDF("v", "cv"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        g = shelf.put(nxt, f"level{level + 1}")
        level += 1
    least = member.groupBy("community").agg(F.min("node").alias("name"))
    return shelf.put(member.join(least, "community").select("node", F.col("name").alias("community")), "louvain")


def modularity(edges: DataFrame, com: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of communities (node, community) of undirected edges (src, dst, weight)."""
    x = both_directions(edges, "weight").join(com.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(com.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    per = x.groupBy("cu").agg(F.sum("weight").alias("t"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0.0)).alias("i"))
    r = per.agg(F.sum("t").alias("m"), F.sum("i").alias("i"), F.sum(F.col("t") * F.col("t")).alias("q")).first()
    return r["i"] / r["m"] - resolution * r["q"] / r["m"] ** 2 if r["m"] else 0.0


def eigenvector(edges: DataFrame, shelf: Shelf, tol: float = 1e-6, most: int = 1000) -> DataFrame:
    """(node, score) of the largest component: power iteration of the weights plus one, scaled to length one.

    Ends when all scores together move by less than nodes times ``tol``; raises if they don't within ``most`` rounds.
    """
    from .iterative import components

    comp = components(edges, shelf)
    top = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    cur = shelf.put(comp.join(F.broadcast(top.select("component")), "component", "left_semi").select("node", F.lit(1.0).alias("score")), "eigen_nodes")
    both = shelf.put(both_directions(edges, "weight").join(cur.select(F.col("node").alias("u")), "u", "left_semi"), "eigen_edges")
    n = cur.count()
    for k in range(0, most, CHAIN):
        for i in range(CHAIN):
            old = cur
            got = both.join(cur.withColumnsRenamed({"node": "v", "score": "x"}), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("got"))
            cur = old.join(got, "node").select("node", (F.col("score") + F.col("got")).alias("score"))
            if i >= CHAIN - 2:  # the last two are compared
                size = cur.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("size"))
                cur = cur.crossJoin(F.broadcast(size)).select("node", (F.col("score") / F.col("size")).alias("score"))  # one row
        cur = shelf.put(cur.join(old.withColumnRenamed("score", "old"), "node"), f"eigen{k}")
        moved = cur.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        cur = cur.select("node", "score")
        shelf.drop(f"eigen{k - CHAIN}")
        if moved < n * tol:
            return cur
    raise RuntimeError(f"eigenvector scores still move after {most} rounds")


def shortest_paths(edges: DataFrame, asked: DataFrame, shelf: Shelf, most: int = 6) -> DataFrame:
    """(source, target, hops, paths, path) of asked pairs (source, target) joined within ``most`` steps.

    ``paths`` counts the shortest paths, ``path`` is the least of them in order
    of nodes.  All pairs advance together, one join a level, and each level
    keeps for a node the number of paths and the least; a pair stops when its
    target is met.  A pair of equal ends has 0 hops.
    """
    both = shelf.put(both_directions(edges.filter("src <> dst")).distinct(), "steps")
    front = shelf.put(asked.select("source", "target").distinct().select("source", "target", F.col("source").alias("node"), F.lit(1).cast("long").alias("paths"), F.array("source").alias("path")), "front0")
    seen, out = front.select("source", "target", "node"), front.filter("node = target").withColumn("hops", F.lit(0))
    for k in range(1, most + 1):
        front = front.join(front.filter("node = target").select("source", "target"), ["source", "target"], "left_anti")
        step = front.join(both.withColumnRenamed("u", "node"), "node").groupBy("source", "target", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"), F.min("path").alias("path"))
        new = step.join(seen, ["source", "target", "node"], "left_anti").select("source", "target", "node", "paths", F.concat("path", F.array("node")).alias("path"))
        front = shelf.put(new, f"front{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("source", "target", "node"))
        out = out.unionByName(front.filter("node = target").withColumn("hops", F.lit(k)))
    return out.select("source", "target", "hops", "paths", "path")
