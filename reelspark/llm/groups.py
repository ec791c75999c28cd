"""Consolidating pairwise matches into groups (problem 1).

Method: seed-tree pruning.  In each round every vertex offers the smallest
vertex of its neighbourhood to all its neighbours (min selection).  A vertex
that isn't offered itself can't be the smallest of its group: it leaves the
graph and hangs in the propagation forest below the smallest vertex offered to
it (pruning); its other offers are linked to that one, so no connection is
lost.  When no edge is left, the remaining vertices are the seeds, and their
ids flow down the forest, from the last pruned level to the first.

Rounds grow with the logarithm of the longest path.  All tables of a round are
distributed; a hub's edges are joined by broadcasting the at most 1000 hubs
that hold more than a thousandth of all edges each (``lookup_join``).

Defined results: ids are compared trimmed and in lower case; a row with a null
or blank side, a null or blank scope, or two equal sides links nothing; an id
without any link to a different id is in no group; repeated rows count once;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators.skew import lookup_join
from ..session import Shelf

_SEP = "\u0001"


def label_components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; strings, a != b, nulls absent): root is the smallest node of the component."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct()
    graph = shelf.put(both, "graph0")
    levels: list[DataFrame] = []
    total = graph.count()
    k = 0
    while total:
        low = shelf.put(graph.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"), F.count("*").alias("n")), f"low{k}")
        offers = lookup_join(graph, total, low, "u", "n").select(F.col("v").alias("x"), "low").unionByName(low.select(F.col("u").alias("x"), "low"))
        offers = shelf.put(offers.distinct(), f"offers{k}")
        best = offers.groupBy("x").agg(F.min("low").alias("best"), F.max(F.col("low") == F.col("x")).alias("stays"), F.count("*").alias("n"))
        best = shelf.put(best, f"best{k}")
        levels.append(best.filter(~F.col("stays")).select(F.col("x").alias("node"), F.col("best").alias("parent")))
        rest = lookup_join(offers, total, best.select("x", "best", "n"), "x", "n").filter(F.col("low") != F.col("best"))
        pair = F.array(F.struct(F.col("low").alias("u"), F.col("best").alias("v")), F.struct(F.col("best").alias("u"), F.col("low").alias("v")))
        graph = shelf.put(rest.select(F.explode(pair).alias("e")).select("e.*").distinct(), f"graph{k + 1}")
        for done in (f"graph{k}", f"low{k}", f"offers{k}"):
            shelf.drop(done)
        k += 1
        total = graph.count()
    if not levels:
        return graph.select(F.col("u").alias("node"), F.col("v").alias("root"))
    labels = levels[-1].select("node", F.col("parent").alias("root"))
    for i in range(len(levels) - 2, -1, -1):
        above = labels.select(F.col("node").alias("parent"), "root")
        below = levels[i].join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        labels = labels.unionByName(below)
        if (len(levels) - i) % 3 == 0:
            labels = shelf.put(labels, f"labels{i}")
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())


def match_groups(pairs: DataFrame, left: str, right: str, scope: str) -> DataFrame:
    """(scope, group_id, record_id) of all groups that the rows of ``pairs`` link, within each value of ``scope``."""
    shelf = Shelf(pairs.sparkSession, "groups")
    s = clean_id(scope)
    edges = pairs.select(F.concat(s, F.lit(_SEP), clean_id(left)).alias("a"), F.concat(s, F.lit(_SEP), clean_id(right)).alias("b")).filter(F.col("a") != F.col("b"))
    part = lambda c, i: F.split_part(F.col(c), F.lit(_SEP), F.lit(i))
    return label_components(edges, shelf).select(part("root", 1).alias(scope), part("root", 2).alias("group_id"), part("node", 2).alias("record_id"))
