"""Scoring: fixed effects, ranks, patronage, dormancy and the composite; and iterative graph measures.

SQL can't iterate to a tolerance, so these have no SQL; tests/test_iterative.py
holds them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import DIRECTORS, EPISODIC, THROUGH, in_list
from ..operators import blocks
from ..operators import iterative as it
from ..operators.akm import Effects, estimate
from ..session import Shelf
from .career_queries import assignments, dormancy
from .domain import Domain
from .network_queries import bipartite_edges, graph, ties
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")


def panel(d: Domain) -> DataFrame:
    """(person, work, studio, y, w, experience, role_w): one observation per person and work with a year and a studio.

    y: log team size times log episodes times duration in half-hours (at most 2).
    w: role weight over the greatest, longer for through-line and shorter for
    episodic roles, scaled by episode coverage and experience, capped at the
    95th percentile and divided by the median.
    """
    work = d.work.filter("year is not null").select("work", F.col("year").alias("wy"), F.coalesce("episodes", F.lit(1)).alias("eps"), F.coalesce("duration", F.lit(24)).alias("dur"), F.col("episodes").alias("known"))
    c = d.crew.select("person", "work", "role", "weight", "episode").join(work, "work")
    staff = c.groupBy("work").agg(F.countDistinct("person").alias("staff"))
    first = F.min("wy").over(Window.partitionBy("person"))
    kind = F.when(F.col("role").isin(*THROUGH), 1.5).when(F.col("role").isin(*EPISODIC), 0.7).otherwise(1.0)
    cover = F.when(F.col("role").isin(*THROUGH), 1.0).when(F.col("role").isin(*EPISODIC) & (F.col("known") > 26), 26.0 / F.col("known")).otherwise(1.0)
    exp = F.least(1 + 0.3 * (1 - F.exp(-(F.col("wy") - first) / 5.0)), F.lit(1.3))
    c = c.withColumn("cw", F.col("weight") / 3.0 * kind * cover * exp)
    c = c.withColumn("experience", F.col("wy") - first)
    x = c.groupBy("person", "work").agg(F.max("wy").alias("year"), F.sum("cw").alias("w"), F.max("experience").alias("experience"), F.max("weight").alias("role_w"), F.max("eps").alias("eps"), F.max("dur").alias("dur")).join(staff, "work")
    x = x.join(assignments(d), ["person", "year"]).withColumn("y", F.log1p("staff") * F.log1p("eps") * F.least(F.col("dur") / 30.0, F.lit(2.0)))
    cap = x.agg(F.percentile("w", F.lit(0.95)).alias("cap"))
    x = x.crossJoin(F.broadcast(cap)).withColumn("w", F.least("w", "cap"))  # one row
    mid = x.agg(F.percentile("w", F.lit(0.5)).alias("mid"))
    return x.crossJoin(F.broadcast(mid)).select("person", "work", "studio", "y", "experience", "role_w", (F.col("w") / F.col("mid")).alias("w"))


def effects(d: Domain, shelf: Shelf) -> Effects:
    p = shelf.put(panel(d), "panel")
    # only the largest set of persons and studios connected by moves identifies the effects
    comp = it.components(p.select(F.concat(F.lit("p|"), "person").alias("src"), F.concat(F.lit("s|"), "studio").alias("dst")), shelf)
    top = comp.groupBy("component").agg(_n().alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = comp.join(F.broadcast(top.select("component")), "component", "left_semi").filter("node like 's|%'").select(F.substring("node", 3, 1 << 20).alias("studio"))
    p = shelf.put(p.join(inside, "studio", "left_semi"), "connected")
    movers = assignments(d).join(p.select("person").distinct(), "person", "left_semi").groupBy("person").agg(F.countDistinct("studio").alias("k")).filter("k > 1").select("person")
    counts = d.credit.groupBy("person").agg(_n().alias("n"))
    return estimate(p, ["experience", "role_w"], shelf.put(movers, "movers"), shelf.put(counts, "counts"), shelf)


@R.query()
def person_effects(d: Domain) -> DataFrame:
    """Person effects beside studio effects: raw; and shrunk, free of the count's slope and with their part of the studio's effect."""
    p, _ = effects(d, Shelf(d.spark, "akm"))
    return p.select("person", F.round("raw", 6).alias("raw"), F.round("effect", 6).alias("effect"), "n")


@R.query()
def studio_effects(d: Domain) -> DataFrame:
    _, s = effects(d, Shelf(d.spark, "akm"))
    return s.select("studio", F.round("effect", 6).alias("effect"))


def ranks(d: Domain, shelf: Shelf) -> DataFrame:
    return it.birank(shelf.put(bipartite_edges(d).select("person", "work", "weight"), "bipartite"), shelf)[0]


@R.query()
def bipartite_rank(d: Domain) -> DataFrame:
    """Rank of persons in the person-work graph."""
    return ranks(d, Shelf(d.spark, "birank")).select("person", F.round("rank", 9).alias("rank"))


_PAT = f", a AS (SELECT DISTINCT work, person AS director, role IN ('director', 'episode_director') AS senior FROM crew WHERE role IN {in_list(DIRECTORS)}), al AS (SELECT work, director, max(senior) AS senior FROM a GROUP BY ALL), k AS (SELECT c.person, al.director, count(*) AS n FROM crew c JOIN al ON al.work = c.work AND al.director <> c.person WHERE c.role NOT IN ('director', 'episode_director') AND (c.role <> 'animation_director' OR al.senior) GROUP BY ALL) SELECT person, count(*) AS patrons, CAST(sum(n) AS BIGINT) AS n_credits, round(sum(ln(1 + n)), 6) AS weight FROM k GROUP BY person"


def patrons(d: Domain) -> DataFrame:
    """(person, director, n): credit rows under each patron; animation directors have senior patrons only, senior directors none."""
    senior = F.col("role").isin("director", "episode_director")
    a = d.crew.filter(F.col("role").isin(*DIRECTORS)).groupBy("work", F.col("person").alias("director")).agg(F.max(senior).alias("senior"))
    c = d.crew.filter(~senior).groupBy("work", "person", "role").agg(_n().alias("k"))
    return c.join(a, "work").filter((F.col("person") != F.col("director")) & ((F.col("role") != "animation_director") | F.col("senior"))).groupBy("person", "director").agg(F.sum("k").alias("n"))


@R.query(_PAT)
def patronage_counts(d: Domain) -> DataFrame:
    return patrons(d).groupBy("person").agg(_n().alias("patrons"), F.sum("n").alias("n_credits"), F.round(F.sum(F.log1p("n")), 6).alias("weight"))


@R.query()
def integrated_values(d: Domain) -> DataFrame:
    """Composite of effect, rank, studio exposure and patronage, times dormancy; weights are the first principal component's."""
    shelf = Shelf(d.spark, "value")
    p, s = effects(d, shelf)
    r = shelf.put(ranks(d, shelf), "ranks")
    pat = patrons(d).join(r.withColumnsRenamed({"person": "director", "rank": "dr"}), "director").groupBy("person").agg(F.sum(F.col("dr") * F.log1p("n")).alias("patronage"))
    years = assignments(d).groupBy("person", "studio").agg(_n().alias("k")).withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("person")))
    exposure = years.join(s, "studio").groupBy("person").agg(F.sum(F.col("share") * F.col("effect")).alias("exposure"))
    x = p.select("person", "effect").join(r, "person", "full").join(exposure, "person", "left").join(pat, "person", "left").join(dormancy(d).select("person", "dormancy"), "person", "left")
    cols = ["effect", "rank", "exposure", "patronage"]
    x = shelf.put(x, "parts")
    y = it.integrated_value(x, cols, it.principal_weights(x, cols), "dormancy")
    return y.select("person", F.round("value", 6).alias("value"), F.round("dormancy", 6).alias("dormancy"))


@R.query()
def core_numbers(d: Domain) -> DataFrame:
    g = graph(d, Shelf(d.spark, "core"))
    return blocks.cores(g).select(F.col("node").alias("person"), "core")


@R.query()
def network_components(d: Domain) -> DataFrame:
    return it.components(ties(d), Shelf(d.spark, "components")).select(F.col("node").alias("person"), "component")


@R.query()
def communities(d: Domain) -> DataFrame:
    return blocks.communities(graph(d, Shelf(d.spark, "communities"), True)).withColumnRenamed("node", "person")


# Betweenness is exact up to so many nodes, from so many sampled sources beyond.
EXACT_NODES, SAMPLED_SOURCES = 500, 200


@R.query()
def betweenness_sample(d: Domain) -> DataFrame:
    """Betweenness: exact up to ``EXACT_NODES``, beyond from ``SAMPLED_SOURCES``; the sample is the operator's feature."""
    g = graph(d, Shelf(d.spark, "between"))
    return blocks.betweenness(g, None if g.n <= EXACT_NODES else SAMPLED_SOURCES).select(F.col("node").alias("person"), F.round("score", 9).alias("score"))


@R.query()
def eigenvector_centrality(d: Domain) -> DataFrame:
    """Eigenvector scores of the largest component, by edge weights."""
    g = graph(d, Shelf(d.spark, "eigen"), True)
    return blocks.eigenvector(g).join(g.ids, "i").select(F.col("node").alias("person"), F.round("score", 6).alias("score"))


@R.query()
def authority(d: Domain) -> DataFrame:
    """Weighted PageRank over the ties in both directions."""
    e = ties(d)
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return it.pagerank(both, Shelf(d.spark, "pagerank")).select(F.col("node").alias("person"), F.round("rank", 9).alias("rank"))


@R.query()
def bridges(d: Domain) -> DataFrame:
    """Ties between communities per person: communities reached and score."""
    return blocks.bridges(graph(d, Shelf(d.spark, "bridges"), True)).select(F.col("node").alias("person"), "communities", F.round("score", 6).alias("score"))


QUERIES, SQL = R.queries, R.sql
