"""Collaboration graph and network analyses that one plan can express.

Pair joins are on the work; the core-team rule keeps a pair only if one side is
core (or the work has no core), so large casts don't pair in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import ANIMATORS, CORE_TEAM, DIRECTORS, in_list
from ..operators import blocks, graphs
from ..operators.sharing import shared_places
from ..session import Shelf
from .domain import Domain
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")


def importance(duration: str = "duration"):  # noqa: ANN201
    """Weight of a work by its duration: half-hours, between 0.01 and 2; 1 if unknown."""
    return F.when(F.col(duration).isNull(), 1.0).otherwise(F.greatest(F.least(F.col(duration) / 30.0, F.lit(2.0)), F.lit(0.01)))


_IMP = "CASE WHEN duration IS NULL THEN 1.0 ELSE greatest(least(duration / 30.0, 2.0), 0.01) END"


def team(d: Domain) -> DataFrame:
    """(work, person, w, core): a person's heaviest role on a work."""
    return d.crew.groupBy("work", "person").agg(F.max("weight").alias("w"), F.max(F.col("role").isin(*CORE_TEAM)).alias("core"))


_TEAM = f", team AS (SELECT work, person, max(weight) AS w, max(role IN {in_list(CORE_TEAM)}) AS core FROM crew GROUP BY ALL)"
_EDGE = _TEAM + f""", has AS (SELECT work, max(core) AS has FROM team GROUP BY work),
edge AS (SELECT a.person AS src, b.person AS dst, count(*) AS shared, sum(sqrt(a.w * b.w) * {_IMP}) AS weight FROM team a JOIN team b ON a.work = b.work AND a.person < b.person JOIN has h ON h.work = a.work LEFT JOIN work k ON k.work = a.work WHERE a.core OR b.core OR NOT h.has GROUP BY ALL)"""


def edges(d: Domain) -> DataFrame:
    """(src, dst, shared, weight), src < dst: pairs of a work of which one is core, or all pairs of a work without core.

    Core rows meet all rows and the rest meets only core rows, so a work's
    non-core staff is never paired with itself.
    """
    t = team(d).join(d.work.select("work", importance().alias("imp")), "work", "left").withColumn("imp", F.coalesce("imp", F.lit(1.0)))
    has = t.groupBy("work").agg(F.max("core").alias("has"))
    t = t.join(has, "work")
    lead = t.filter("core or not has").select("work", F.col("person").alias("p"), F.col("w").alias("wp"), F.col("core").alias("cp"))
    rest = t.select("work", F.col("person").alias("q"), F.col("w").alias("wq"), F.col("core").alias("cq"), "has", "imp")
    # a pair with two leading sides is found twice: keep the one in order
    both = F.col("cq") | ~F.col("has")
    pairs = lead.join(rest, "work").filter((F.col("p") != F.col("q")) & (~both | (F.col("p") < F.col("q"))))
    return pairs.groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(_n().alias("shared"), F.sum(F.sqrt(F.col("wp") * F.col("wq")) * F.col("imp")).alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    """(u, v, shared, weight) in both directions."""
    return graphs.both_directions(e, "shared", "weight")


def ties(d: Domain, least: int = 1) -> DataFrame:
    """The edges of at least so many shared works; all of them unless asked otherwise."""
    return edges(d) if least <= 1 else edges(d).filter(F.col("shared") >= least)


def led_teams(d: Domain) -> DataFrame:
    """(work, person, lead, a, imp) for ``blocks.teams``: the graph of ``edges``, pairs with a core side or of a work without core."""
    t = team(d).join(d.work.select("work", importance().alias("imp")), "work", "left")
    has = t.groupBy("work").agg(F.max("core").alias("has"))
    return t.join(has, "work").select("work", "person", (F.col("core") | ~F.col("has")).alias("lead"), F.sqrt("w").alias("a"), F.coalesce("imp", F.lit(1.0)).alias("imp"))


def graph(d: Domain, shelf: Shelf, weighted: bool = False) -> blocks.Blocks:
    """The whole collaboration graph (the pairs of ``edges``) in blocks of neighbour lists."""
    return blocks.collaboration(led_teams(d), shelf, weighted)


_BOTH = _EDGE + ", nb AS (SELECT src AS u, dst AS v, shared, weight FROM edge UNION ALL SELECT dst, src, shared, weight FROM edge)"
_TIES = _EDGE + ", tie AS MATERIALIZED (SELECT * FROM edge), nb AS MATERIALIZED (SELECT src AS u, dst AS v FROM tie UNION ALL SELECT dst, src FROM tie)"


@R.query(_EDGE + " SELECT src, dst, shared, round(weight, 6) AS weight FROM edge")
def collaboration_edges(d: Domain) -> DataFrame:
    return edges(d).select("src", "dst", "shared", F.round("weight", 6).alias("weight"))


@R.query(f", sc AS (SELECT work, count(DISTINCT person) AS n FROM crew GROUP BY work), med AS (SELECT median(n) AS m FROM sc) SELECT c.person, c.work, round(sum(c.weight) * any_value({_IMP.replace('duration', 'k.duration')} * ln(1 + sc.n) / ln(1 + med.m)), 6) AS weight, count(*) AS n_credits FROM crew c JOIN sc ON sc.work = c.work LEFT JOIN work k ON k.work = c.work CROSS JOIN med GROUP BY ALL")
def bipartite_edges(d: Domain) -> DataFrame:
    """Person-work edges weighted by role and production scale relative to the median team."""
    size = d.crew.groupBy("work").agg(F.countDistinct("person").alias("n"))
    med = size.agg(F.percentile("n", F.lit(0.5)).alias("m"))
    scale = size.join(d.work.select("work", importance().alias("imp")), "work", "left").crossJoin(F.broadcast(med))  # one row
    scale = scale.select("work", (F.coalesce("imp", F.lit(1.0)) * F.log1p("n") / F.log1p("m")).alias("scale"))
    return d.crew.groupBy("person", "work").agg(F.sum("weight").alias("w"), _n().alias("n_credits")).join(scale, "work").select("person", "work", F.round(F.col("w") * F.col("scale"), 6).alias("weight"), "n_credits")


@R.query(f", x AS (SELECT DISTINCT work, person, weight, role FROM crew), a AS (SELECT work, person, max(weight) AS w FROM x WHERE role IN {in_list(DIRECTORS)} GROUP BY ALL), b AS (SELECT work, person, max(weight) AS w FROM x WHERE role IN {in_list(ANIMATORS)} GROUP BY ALL) SELECT a.person AS director, b.person AS animator, count(*) AS n_works, round(sum((a.w + b.w) / 2 * {_IMP}), 6) AS weight FROM a JOIN b ON a.work = b.work AND a.person <> b.person LEFT JOIN work k ON k.work = a.work GROUP BY ALL")
def director_animator_edges(d: Domain) -> DataFrame:
    part = lambda roles, c: d.crew.filter(F.col("role").isin(*roles)).groupBy("work", F.col("person").alias(c)).agg(F.max("weight").alias(f"w_{c}"))
    x = part(DIRECTORS, "director").join(part(ANIMATORS, "animator"), "work").filter("director <> animator").join(d.work.select("work", importance().alias("imp")), "work", "left")
    return x.groupBy("director", "animator").agg(_n().alias("n_works"), F.round(F.sum((F.col("w_director") + F.col("w_animator")) / 2 * F.coalesce("imp", F.lit(1.0))), 6).alias("weight"))


@R.query(", x AS (SELECT person, category, count(*) AS n FROM crew GROUP BY ALL) SELECT person, arg_max(category, (n, category)) AS primary_role, CAST(sum(n) AS BIGINT) AS n_credits FROM x GROUP BY person")
def primary_role(d: Domain) -> DataFrame:
    """Most frequent category of each person; ties go to the greater name."""
    x = d.crew.groupBy("person", "category").agg(_n().alias("n"))
    return x.groupBy("person").agg(F.max_by("category", F.struct("n", "category")).alias("primary_role"), F.sum("n").alias("n_credits"))


@R.query(_BOTH + ", n AS (SELECT count(DISTINCT u) AS n FROM nb) SELECT u AS person, count(*) AS degree, round(count(*) / (any_value(n.n) - 1), 6) AS centrality, round(sum(weight), 6) AS strength FROM nb CROSS JOIN n GROUP BY u")
def degree_centrality(d: Domain) -> DataFrame:
    g = both_ways(edges(d)).groupBy("u").agg(_n().alias("degree"), F.round(F.sum("weight"), 6).alias("strength"))
    n = g.agg(_n().alias("n"))
    return g.crossJoin(F.broadcast(n)).select(F.col("u").alias("person"), "degree", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality"), "strength")


@R.query(_TIES + ", n AS (SELECT count(DISTINCT u) AS n, count(*) // 2 AS e FROM nb), t AS (SELECT count(*) AS t FROM tie a JOIN tie b ON b.src = a.dst JOIN tie c ON c.src = a.src AND c.dst = b.dst), w AS (SELECT sum(k * (k - 1) // 2) AS w FROM (SELECT count(*) AS k FROM nb GROUP BY u)) SELECT CAST(n AS BIGINT) AS nodes, CAST(e AS BIGINT) AS edges, round(2.0 * e / (n * (n - 1)), 9) AS density, CAST(t AS BIGINT) AS triangles, round(3.0 * t / w, 6) AS transitivity FROM n, t, w")
def graph_summary(d: Domain) -> DataFrame:
    """Counts, density, triangles and transitivity; triangles from the common neighbours of every tie."""
    g = graph(d, Shelf(d.spark, "summary"))
    tot = blocks.degrees(g).agg(_n().alias("n"), F.expr("sum(k) div 2").alias("e"), F.sum(F.expr("k * (k - 1) div 2")).alias("w"))
    tri = blocks.closed(g).agg(F.expr("sum(t) div 3").alias("t"))
    return tot.crossJoin(tri).select(F.col("n").alias("nodes"), F.col("e").alias("edges"), F.round(2.0 * F.col("e") / (F.col("n") * (F.col("n") - 1)), 9).alias("density"), F.col("t").alias("triangles"), F.round(3.0 * F.col("t") / F.col("w"), 6).alias("transitivity"))


@R.query(_TIES + ", k AS (SELECT u, count(*) AS deg FROM nb GROUP BY u), c AS (SELECT a.u, a.v AS j, count(b.v) AS common, sum(CASE WHEN b.v IS NOT NULL THEN 1.0 / kb.deg END) AS s FROM nb a LEFT JOIN (nb x JOIN nb b ON b.u = x.v) ON x.u = a.u AND b.v = a.v LEFT JOIN k kb ON kb.u = x.v GROUP BY ALL) SELECT c.u AS person, round(sum(power(1.0 / k.deg + coalesce(s, 0) / k.deg, 2)), 6) AS constraint_, round(any_value(k.deg) - sum(common - 1.0) / any_value(k.deg), 6) AS effective_size FROM c JOIN k ON k.u = c.u GROUP BY c.u")
def structural_holes(d: Domain) -> DataFrame:
    """Constraint and effective size from common neighbours, unweighted."""
    x = blocks.constraint(graph(d, Shelf(d.spark, "holes")))
    return x.select(F.col("node").alias("person"), F.round("constraint_", 6).alias("constraint_"), F.round(F.col("k") - F.col("redundant") / F.col("k"), 6).alias("effective_size"))


@R.query(_TIES + ", r AS (SELECT u, v FROM nb UNION SELECT a.u, b.v FROM nb a JOIN nb b ON b.u = a.v WHERE a.u <> b.v), n AS (SELECT count(DISTINCT u) AS n FROM nb) SELECT u AS person, count(*) AS n_reached, round(count(*) / any_value(n.n), 4) AS reach FROM r CROSS JOIN n GROUP BY u")
def reach(d: Domain) -> DataFrame:
    """Share of the network within two steps."""
    shelf = Shelf(d.spark, "reach")
    x = shelf.put(blocks.two_step_reach(led_teams(d), shelf), "reach")
    return x.crossJoin(F.broadcast(x.agg(_n().alias("n")))).select(F.col("node").alias("person"), "n_reached", F.round(F.col("n_reached") / F.col("n"), 4).alias("reach"))


@R.query(_TEAM + ", p AS (SELECT a.person AS src, b.person AS dst, count(*) AS n, min(k.year) AS y0, max(k.year) AS y1 FROM team a JOIN team b ON a.work = b.work AND a.person < b.person AND (a.core OR b.core) LEFT JOIN work k ON k.work = a.work GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT max(n) AS m FROM p) SELECT src, dst, n AS shared_works, y0 AS first_year, y1 AS last_year, round(least(n / greatest(m, 1), 1.0) * 50 + least(coalesce(y1 - y0, 0) / 10.0, 1.0) * 30 + CASE WHEN y1 >= 2020 THEN 20 WHEN y1 >= 2015 THEN 10 ELSE 0 END, 6) AS strength FROM p CROSS JOIN m")
def collaboration_strength(d: Domain) -> DataFrame:
    """Strength of repeated pairs with a core side: frequency, duration and recency."""
    t = team(d).join(d.work.select("work", "year"), "work", "left")
    lead = t.filter("core").select("work", F.col("person").alias("p"))
    rest = t.select("work", F.col("person").alias("q"), F.col("core").alias("cq"), "year")
    pairs = lead.join(rest, "work").filter((F.col("p") != F.col("q")) & (~F.col("cq") | (F.col("p") < F.col("q"))))
    p = pairs.groupBy(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(_n().alias("shared_works"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).filter("shared_works >= 2")
    m = p.agg(F.max("shared_works").alias("m"))
    span = F.coalesce(F.col("last_year") - F.col("first_year"), F.lit(0))
    s = F.least(F.col("shared_works") / F.greatest("m", F.lit(1)), F.lit(1.0)) * 50 + F.least(span / 10.0, F.lit(1.0)) * 30 + F.when(F.col("last_year") >= 2020, 20).when(F.col("last_year") >= 2015, 10).otherwise(0)
    return p.crossJoin(F.broadcast(m)).select("src", "dst", "shared_works", "first_year", "last_year", F.round(s, 6).alias("strength"))


@R.query(_BOTH + ", t AS (SELECT u, shared, shared / sum(shared) OVER (PARTITION BY u) AS p, count(*) OVER (PARTITION BY u) AS k FROM nb) SELECT u AS person, count(*) AS partners, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0.0 END, 6) AS diversity, round(100.0 * count(*) FILTER (WHERE shared >= 2) / count(*), 6) AS repeat_rate, round(100.0 * max(p), 6) AS top_share FROM t GROUP BY u")
def collaboration_diversity(d: Domain) -> DataFrame:
    t = both_ways(edges(d)).withColumn("p", F.col("shared") / F.sum("shared").over(Window.partitionBy("u")))
    h = F.when(_n() > 1, -F.sum(F.col("p") * F.log2("p")) / F.log2(_n())).otherwise(0.0)
    return t.groupBy(F.col("u").alias("person")).agg(_n().alias("partners"), F.round(h, 6).alias("diversity"), F.round(100.0 * F.count_if(F.col("shared") >= 2) / _n(), 6).alias("repeat_rate"), F.round(100.0 * F.max("p"), 6).alias("top_share"))


@R.query(", p AS (SELECT DISTINCT work, person FROM crew), x AS (SELECT a.person, count(DISTINCT b.person) AS collaborators, count(DISTINCT a.work) AS works FROM p a JOIN p b ON a.work = b.work AND a.person <> b.person GROUP BY a.person), m AS (SELECT max(collaborators) AS m FROM x) SELECT person, collaborators, works, round(collaborators / m * 100, 6) AS hub_score FROM x CROSS JOIN m")
def network_density(d: Domain) -> DataFrame:
    p = d.crew.select("work", "person").distinct()
    x = p.join(p.withColumnRenamed("person", "o"), "work").filter("person <> o").groupBy("person").agg(F.countDistinct("o").alias("collaborators"), F.countDistinct("work").alias("works"))
    m = x.agg(F.max("collaborators").alias("m"))
    return x.crossJoin(F.broadcast(m)).select("person", "collaborators", "works", F.round(F.col("collaborators") / F.col("m") * 100, 6).alias("hub_score"))


@R.query(_TEAM + ", y AS (SELECT t.person, t.work, k.year FROM team t JOIN work k ON k.work = t.work WHERE k.year IS NOT NULL), f AS (SELECT person, min(year) AS debut FROM y GROUP BY person), a AS (SELECT year, count(DISTINCT person) AS active FROM y GROUP BY year), nw AS (SELECT debut AS year, count(*) AS new_persons FROM f GROUP BY debut), pr AS (SELECT a.person AS s, b.person AS t, min(k.year) AS first FROM team a JOIN team b ON a.work = b.work AND a.person < b.person AND (a.core OR b.core) JOIN work k ON k.work = a.work WHERE k.year IS NOT NULL GROUP BY ALL), ne AS (SELECT first AS year, count(*) AS new_edges FROM pr GROUP BY first) SELECT a.year, a.active, coalesce(new_persons, 0) AS new_persons, coalesce(new_edges, 0) AS new_edges, CAST(sum(coalesce(new_persons, 0)) OVER (ORDER BY a.year) AS BIGINT) AS persons, CAST(sum(coalesce(new_edges, 0)) OVER (ORDER BY a.year) AS BIGINT) AS edges FROM a LEFT JOIN nw ON nw.year = a.year LEFT JOIN ne ON ne.year = a.year")
def network_evolution(d: Domain) -> DataFrame:
    """Yearly and cumulative growth of persons and pairs (with a core side)."""
    t = team(d).join(d.work.filter("year is not null").select("work", "year"), "work")
    active = t.groupBy("year").agg(F.countDistinct("person").alias("active"))
    new = t.groupBy("person").agg(F.min("year").alias("year")).groupBy("year").agg(_n().alias("new_persons"))
    lead = t.filter("core").select("work", F.col("person").alias("p"), "year")
    pairs = lead.join(t.select("work", F.col("person").alias("q"), F.col("core").alias("cq")), "work").filter((F.col("p") != F.col("q")) & (~F.col("cq") | (F.col("p") < F.col("q"))))
    first = pairs.groupBy(F.least("p", "q"), F.greatest("p", "q")).agg(F.min("year").alias("year")).groupBy("year").agg(_n().alias("new_edges"))
    x = active.join(new, "year", "left").join(first, "year", "left").fillna(0, ["new_persons", "new_edges"])
    w = Window.partitionBy(F.lit(1)).orderBy("year")  # one row a year
    return x.withColumns({"persons": F.sum("new_persons").over(w), "edges": F.sum("new_edges").over(w)})


@R.query(f", x AS (SELECT DISTINCT work, person AS director FROM crew WHERE role IN {in_list(DIRECTORS)}), t AS (SELECT director, count(*) AS total FROM x GROUP BY director HAVING count(*) >= 3) SELECT x.director, c.person, count(*) AS n_credits, count(DISTINCT c.work) AS n_works, round(count(DISTINCT c.work) / any_value(t.total), 6) AS hit_rate, max(c.year) AS last_year FROM x JOIN t ON t.director = x.director JOIN crew c ON c.work = x.work AND c.person <> x.director GROUP BY ALL HAVING count(*) >= 2")
def director_circles(d: Domain) -> DataFrame:
    """Regular collaborators of directors with at least three works."""
    x = d.crew.filter(F.col("role").isin(*DIRECTORS)).select("work", F.col("person").alias("director")).distinct()
    t = x.groupBy("director").agg(_n().alias("total")).filter("total >= 3")
    c = x.join(t, "director").join(d.crew.select("work", "person", "year"), "work").filter("person <> director")
    return c.groupBy("director", "person").agg(_n().alias("n_credits"), F.countDistinct("work").alias("n_works"), F.round(F.countDistinct("work") / F.max("total"), 6).alias("hit_rate"), F.max("year").alias("last_year")).filter("n_credits >= 2")


@R.query(f", x AS (SELECT DISTINCT work, person AS director FROM crew WHERE role IN {in_list(DIRECTORS)}), dw AS (SELECT director, count(*) AS total FROM x GROUP BY director), p AS (SELECT c.person, x.director, count(*) AS n, sum(c.weight * exp(-0.1 * greatest(2025 - coalesce(c.year, 2025), 0))) AS s FROM crew c JOIN x ON x.work = c.work AND x.director <> c.person GROUP BY ALL) SELECT person, count(*) AS directors, round(sum(ln(1 + n) * s + 0.3 * s * ln(1 + total) / ln(10)), 6) AS raw_trust FROM p JOIN dw ON dw.director = p.director GROUP BY person")
def trust_raw(d: Domain) -> DataFrame:
    """Repeated engagement by directors, weighted by role and recency."""
    x = d.crew.filter(F.col("role").isin(*DIRECTORS)).select("work", F.col("person").alias("director")).distinct()
    dw = x.groupBy("director").agg(_n().alias("total"))
    age = F.exp(-0.1 * F.greatest(2025 - F.coalesce("year", F.lit(2025)), F.lit(0)))
    p = d.crew.join(x, "work").filter("person <> director").groupBy("person", "director").agg(_n().alias("n"), F.sum(F.col("weight") * age).alias("s")).join(dw, "director")
    return p.groupBy("person").agg(_n().alias("directors"), F.round(F.sum(F.log1p("n") * F.col("s") + 0.3 * F.col("s") * F.log1p("total") / F.log(F.lit(10.0))), 6).alias("raw_trust"))


@R.query(", m AS (SELECT work, person, max(stage) AS stage, count(*) AS n FROM crew GROUP BY ALL) SELECT a.person AS mentor, b.person AS mentee, CAST(sum(a.n * b.n) AS BIGINT) AS n_pairs, count(*) AS n_works, max(a.stage) AS mentor_stage, max(b.stage) AS mentee_stage FROM m a JOIN m b ON a.work = b.work AND a.stage - b.stage >= 2 GROUP BY ALL HAVING count(*) >= 3")
def mentorships(d: Domain) -> DataFrame:
    """Pairs two career stages apart on at least three works."""
    m = d.crew.groupBy("work", "person").agg(F.max("stage").alias("stage"), _n().alias("n"))
    a, b = (m.select("work", F.col("person").alias(x), F.col("stage").alias(f"{x}_stage"), F.col("n").alias(f"n_{x}")) for x in ("mentor", "mentee"))
    x = a.join(b, "work").filter(F.col("mentor_stage") - F.col("mentee_stage") >= 2)
    return x.groupBy("mentor", "mentee").agg(F.sum(F.col("n_mentor") * F.col("n_mentee")).alias("n_pairs"), _n().alias("n_works"), F.max("mentor_stage").alias("mentor_stage"), F.max("mentee_stage").alias("mentee_stage")).filter("n_works >= 3")


_TOP = _TEAM + ", top AS (SELECT work, person FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY w DESC, person) AS k FROM team WHERE core) WHERE k <= 20)"


def core_staff(d: Domain) -> DataFrame:
    """The 20 leading core members of each work: the cap is part of the report."""
    w = Window.partitionBy("work").orderBy(F.desc("w"), "person")
    return team(d).filter("core").withColumn("k", F.row_number().over(w)).filter("k <= 20").select("work", "person")


@R.query(_TOP + " SELECT a.person AS p1, b.person AS p2, c.person AS p3, count(*) AS n_works FROM top a JOIN top b ON b.work = a.work AND b.person > a.person JOIN top c ON c.work = a.work AND c.person > b.person GROUP BY ALL HAVING count(*) >= 3")
def cooccurrence_triples(d: Domain) -> DataFrame:
    t = core_staff(d)
    a, b, c = (t.select("work", F.col("person").alias(x)) for x in ("p1", "p2", "p3"))
    return a.join(b, "work").filter("p2 > p1").join(c, "work").filter("p3 > p2").groupBy("p1", "p2", "p3").agg(_n().alias("n_works")).filter("n_works >= 3")


_GROUP = ", natl AS (SELECT person, CASE WHEN nationality = 'JP' THEN 'JP' WHEN nationality IS NULL OR nationality = '' THEN 'UNK' ELSE 'FOREIGN' END AS grp FROM person)"


def _nations(d: Domain) -> DataFrame:
    nat = F.col("nationality")
    return d.person.select("person", F.when(nat == "JP", "JP").when(nat.isNull() | (nat == ""), "UNK").otherwise("FOREIGN").alias("grp"))


@R.query(_GROUP + " SELECT c.year, count(*) FILTER (WHERE grp = 'FOREIGN') AS foreign_credits, count(*) FILTER (WHERE grp = 'JP') AS home_credits, count(*) FILTER (WHERE coalesce(grp, 'UNK') = 'UNK') AS unknown, round(CASE WHEN count(*) FILTER (WHERE grp IN ('FOREIGN', 'JP')) >= 5 THEN count(*) FILTER (WHERE grp = 'FOREIGN') / count(*) FILTER (WHERE grp IN ('FOREIGN', 'JP')) END, 6) AS foreign_share FROM crew c LEFT JOIN natl n ON n.person = c.person WHERE c.year IS NOT NULL GROUP BY c.year")
def foreign_ratio(d: Domain) -> DataFrame:
    c = d.crew.filter("year is not null").join(_nations(d), "person", "left")
    k = lambda *g: F.count_if(F.col("grp").isin(*g))
    return c.groupBy("year").agg(k("FOREIGN").alias("foreign_credits"), k("JP").alias("home_credits"), F.count_if(F.coalesce("grp", F.lit("UNK")) == "UNK").alias("unknown"), F.round(F.when(k("FOREIGN", "JP") >= 5, k("FOREIGN") / k("FOREIGN", "JP")), 6).alias("foreign_share"))


@R.query(_GROUP + ", x AS (SELECT c.work, count(DISTINCT CASE WHEN grp = 'JP' THEN c.person END) AS h, count(DISTINCT CASE WHEN grp = 'FOREIGN' THEN c.person END) AS f FROM crew c JOIN natl n ON n.person = c.person GROUP BY c.work) SELECT k.year, CAST(sum(h * f) AS BIGINT) AS pairs, round(avg(h * f), 6) AS per_work FROM x JOIN work k ON k.work = x.work WHERE k.year IS NOT NULL GROUP BY k.year")
def foreign_pair_density(d: Domain) -> DataFrame:
    """Domestic-foreign pairs per year, from counts of the two groups per work."""
    n = lambda g: F.countDistinct(F.when(F.col("grp") == g, F.col("person")))
    x = d.crew.join(_nations(d), "person").groupBy("work").agg((n("JP") * n("FOREIGN")).alias("k"))
    return x.join(d.work.filter("year is not null").select("work", "year"), "work").groupBy("year").agg(F.sum("k").alias("pairs"), F.round(F.avg("k"), 6).alias("per_work"))


@R.query(_GROUP + " SELECT s.studio, count(*) AS n_credits, round(count(*) FILTER (WHERE grp = 'FOREIGN') / count(*), 6) AS foreign_share FROM crew c JOIN studio s ON s.work = c.work LEFT JOIN natl n ON n.person = c.person GROUP BY s.studio HAVING count(*) >= 10")
def studio_foreign_share(d: Domain) -> DataFrame:
    c = d.crew.join(d.studio, "work").join(_nations(d), "person", "left")
    return c.groupBy("studio").agg(_n().alias("n_credits"), F.round(F.count_if(F.col("grp") == "FOREIGN") / _n(), 6).alias("foreign_share")).filter("n_credits >= 10")


@R.query(", y AS (SELECT DISTINCT c.person, c.year, s.studio FROM crew c JOIN studio s ON s.work = c.work WHERE c.year IS NOT NULL AND s.main) SELECT least(a.studio, b.studio) AS studio_a, greatest(a.studio, b.studio) AS studio_b, count(DISTINCT a.person) AS n_persons FROM y a JOIN y b ON a.person = b.person AND b.year - a.year BETWEEN 0 AND 2 AND a.studio <> b.studio GROUP BY ALL")
def talent_sharing(d: Domain) -> DataFrame:
    """Persons two studios share within two years."""
    y = d.crew.filter("year is not null").join(d.studio.filter("main"), "work").select(F.col("person").alias("member"), "year", F.col("studio").alias("place")).distinct()
    return shared_places(y, Shelf(d.spark, "sharing")).toDF("studio_a", "studio_b", "n_persons")


@R.query(" SELECT a.studio AS studio_a, b.studio AS studio_b, count(*) AS n_works FROM studio a JOIN studio b ON a.work = b.work AND a.studio < b.studio GROUP BY ALL")
def coproduction(d: Domain) -> DataFrame:
    a, b = (d.studio.select("work", F.col("studio").alias(f"studio_{x}")) for x in "ab")
    return a.join(b, "work").filter("studio_a < studio_b").groupBy("studio_a", "studio_b").agg(_n().alias("n_works"))


@R.query(", m AS (SELECT work, person, max(CASE role WHEN 'MAIN' THEN 3 WHEN 'SUPPORTING' THEN 2 ELSE 1 END) AS r FROM voice GROUP BY ALL) SELECT least(a.person, b.person) AS va_a, greatest(a.person, b.person) AS va_b, count(*) AS n_works, count(*) FILTER (WHERE a.r = 3 AND b.r = 3) AS co_main, round(sqrt(count(*)) * (1 + count(*) FILTER (WHERE a.r = 3 AND b.r = 3) / count(*)), 6) AS synergy FROM m a JOIN m b ON a.work = b.work AND a.r = 3 AND (b.r < 3 OR a.person < b.person) AND a.person <> b.person GROUP BY ALL HAVING count(*) >= 2")
def va_synergy(d: Domain) -> DataFrame:
    """Voice-actor pairs with a leading side."""
    rank = F.when(F.col("role") == "MAIN", 3).when(F.col("role") == "SUPPORTING", 2).otherwise(1)
    m = d.cast.groupBy("work", "person").agg(F.max(rank).alias("r"))
    x = m.filter("r = 3").select("work", F.col("person").alias("a")).join(m.select("work", F.col("person").alias("b"), "r"), "work").filter((F.col("a") != F.col("b")) & ((F.col("r") < 3) | (F.col("a") < F.col("b"))))
    main = F.count_if(F.col("r") == 3)
    return x.groupBy(F.least("a", "b").alias("va_a"), F.greatest("a", "b").alias("va_b")).agg(_n().alias("n_works"), main.alias("co_main"), F.round(F.sqrt(_n()) * (1 + main / _n()), 6).alias("synergy")).filter("n_works >= 2")


@R.query(", x AS (SELECT person, role, count(*) AS n FROM voice GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY person) AS p FROM x), h AS (SELECT person, -sum(p * log2(p)) AS h FROM t GROUP BY person) SELECT v.person, count(DISTINCT \"character\") AS characters, count(DISTINCT work) AS works, round(any_value(h.h), 6) AS role_entropy FROM voice v JOIN h ON h.person = v.person GROUP BY v.person")
def va_diversity(d: Domain) -> DataFrame:
    x = d.cast.groupBy("person", "role").agg(_n().alias("n"))
    h = x.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("person"))).groupBy("person").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    c = d.cast.groupBy("person").agg(F.countDistinct("character").alias("characters"), F.countDistinct("work").alias("works"))
    return c.join(h, "person").select("person", "characters", "works", F.round("h", 6).alias("role_entropy"))


@R.query(f", sd AS (SELECT DISTINCT work, person AS director FROM crew WHERE role = 'sound_director'), p AS (SELECT v.person, sd.director, count(DISTINCT v.work) AS n, max(k.year) AS last FROM voice v JOIN sd ON sd.work = v.work LEFT JOIN work k ON k.work = v.work GROUP BY ALL) SELECT person, count(*) AS directors, round(sum(ln(1 + n) * exp(-0.1 * greatest(2025 - coalesce(last, 2025), 0))), 6) AS trust FROM p GROUP BY person")
def va_trust(d: Domain) -> DataFrame:
    """Trust of sound directors in voice actors."""
    sd = d.crew.filter("role = 'sound_director'").select("work", F.col("person").alias("director")).distinct()
    p = d.cast.select("work", "person").distinct().join(sd, "work").join(d.work.select("work", "year"), "work", "left").groupBy("person", "director").agg(F.countDistinct("work").alias("n"), F.max("year").alias("last"))
    return p.groupBy("person").agg(_n().alias("directors"), F.round(F.sum(F.log1p("n") * F.exp(-0.1 * F.greatest(2025 - F.coalesce("last", F.lit(2025)), F.lit(0)))), 6).alias("trust"))


QUERIES, SQL = R.queries, R.sql
