"""Resolution of persons and works, paths, brokerage, series and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textual import parse_episodes
from ..operators import blocks
from ..operators.iterative import components
from ..session import Shelf
from .career_queries import _MAIN, _YEAR, assignments, person_years
from .domain import Domain
from .network_queries import _TIES, both_ways, graph, team, ties
from .network_queries import _TEAM as _TEAM_SQL
from .profile_queries import _ALIKE, _LIKE, _ROMAJI_SQL, alike_names, romaji_matches
from .quality_queries import _NAME, _name
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")

_LINKS = _LIKE + _ROMAJI_SQL + f""", nm AS (SELECT person, {_NAME.format('name_ja')} AS k FROM person WHERE coalesce(name_ja, '') <> ''), fm AS (SELECT k, min(person) AS m FROM nm WHERE k <> '' GROUP BY k HAVING count(*) > 1),
e0 AS (SELECT nm.person AS a, fm.m AS b FROM nm JOIN fm ON fm.k = nm.k WHERE nm.person <> fm.m UNION SELECT pa, pb FROM lk WHERE {_ALIKE} UNION SELECT rn.person, rm.canonical FROM rn JOIN rm ON rm.k = rn.k WHERE rn.src = 'anilist'),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), rc AS (SELECT a AS node, a AS seen FROM e UNION SELECT rc.node, e.b FROM rc JOIN e ON e.a = rc.seen)
SELECT node AS person, min(seen) AS canonical FROM rc GROUP BY node"""


@R.query(_LINKS)
def resolved_persons(d: Domain) -> DataFrame:
    """Canonical id of persons linked by equal names, by alike names of one source or by Latin names of two, closed over chains."""
    nm = d.person.filter(F.coalesce("name_ja", F.lit("")) != "").select("person", _name("name_ja").alias("k")).filter("k <> ''")
    least = nm.groupBy("k").agg(F.min("person").alias("m"))
    exact = nm.join(least, "k").filter("person <> m").select(F.col("person").alias("src"), F.col("m").alias("dst"))
    links = exact.unionByName(alike_names(d).toDF("src", "dst")).unionByName(romaji_matches(d).select(F.col("person").alias("src"), F.col("canonical").alias("dst")))
    return components(links, Shelf(d.spark, "persons")).select(F.col("node").alias("person"), F.col("component").alias("canonical"))


_CORE = "regexp_replace(trim(title), '[ ・]*(第?[0-9]+期|第[0-9]+シリーズ|Season ?[0-9]+|PART ?[0-9]+|その[0-9]+|II+|[0-9])$', '')"


def series_core():  # noqa: ANN201
    return F.regexp_replace(F.trim("title"), "[ ・]*(第?[0-9]+期|第[0-9]+シリーズ|Season ?[0-9]+|PART ?[0-9]+|その[0-9]+|II+|[0-9])$", "")


_SERIES = f", sr AS (SELECT work, year, {_CORE} AS core FROM work WHERE coalesce(title, '') <> ''), ser AS (SELECT work, year, min(work) OVER (PARTITION BY core) AS series, count(*) OVER (PARTITION BY core) AS n FROM sr WHERE length(core) >= 4)"


def series(d: Domain) -> DataFrame:
    """(work, year, series, n): works of one title without its season mark; the series is named by its smallest id."""
    s = d.work.filter(F.coalesce("title", F.lit("")) != "").select("work", "year", series_core().alias("core")).filter("length(core) >= 4")
    g = s.groupBy("core").agg(F.min("work").alias("series"), _n().alias("n"))
    return s.join(g, "core").select("work", "year", "series", "n")


@R.query(_SERIES + " SELECT work, series FROM ser WHERE n > 1")
def series_clusters(d: Domain) -> DataFrame:
    return series(d).filter("n > 1").select("work", "series")


@R.query(_TEAM_SQL + _SERIES + ", st AS (SELECT DISTINCT t.person, ser.series, t.work FROM team t JOIN ser ON ser.work = t.work WHERE ser.n > 1 AND t.core) SELECT a.person AS person_a, b.person AS person_b, a.series, count(*) AS n, round(ln(1 + count(*)) / ln(2) * 0.3, 6) AS synergy FROM st a JOIN st b ON a.work = b.work AND a.series = b.series AND a.person < b.person GROUP BY ALL HAVING count(*) >= 2")
def series_synergy(d: Domain) -> DataFrame:
    """Core pairs that return over works of one series."""
    st = team(d).filter("core").join(series(d).filter("n > 1").select("work", "series"), "work").select("work", "series", "person")
    a, b = (st.select("work", "series", F.col("person").alias(f"person_{c}")) for c in "ab")
    x = a.join(b, ["work", "series"]).filter("person_a < person_b").groupBy("person_a", "person_b", "series").agg(_n().alias("n")).filter("n >= 2")
    return x.withColumn("synergy", F.round(F.log1p("n") / F.log(F.lit(2.0)) * 0.3, 6))


_SEED = ", deg AS (SELECT u, count(*) AS k FROM nb GROUP BY u), seed AS (SELECT u FROM deg ORDER BY k DESC, u LIMIT 1)"


def hops(d: Domain, shelf: Shelf, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(node, hops) from the person with most ties (ties: smaller id), by levels; and the edges both ways."""
    b = shelf.put(both_ways(ties(d)).select("u", "v"), "both")
    seed = b.groupBy("u").agg(_n().alias("k")).orderBy(F.desc("k"), "u").limit(1).select(F.col("u").alias("node"))
    seen = front = shelf.put(seed.withColumn("hops", F.lit(0)), "hop0")
    for k in range(1, most + 1):
        new = front.join(b.withColumnRenamed("u", "node"), "node").select(F.col("v").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = shelf.put(new.withColumn("hops", F.lit(k)), f"hop{k}")
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    return seen, b


@R.query(_TIES + _SEED + ", walk AS (SELECT u AS node, 0 AS hops FROM seed UNION SELECT nb.v, w.hops + 1 FROM walk w JOIN nb ON nb.u = w.node WHERE w.hops < 6) SELECT node AS person, min(hops) AS hops FROM walk GROUP BY node")
def separation(d: Domain) -> DataFrame:
    """Steps between the best connected person and everyone within six."""
    return hops(d, Shelf(d.spark, "separation"))[0].select(F.col("node").alias("person"), "hops")


@R.query(_TIES + _SEED + ", ego AS (SELECT u AS node FROM seed UNION SELECT nb.v FROM nb JOIN seed ON seed.u = nb.u) SELECT t.src, t.dst, t.shared FROM tie t WHERE EXISTS (SELECT 1 FROM ego WHERE node = t.src) AND EXISTS (SELECT 1 FROM ego WHERE node = t.dst)")
def ego_graph(d: Domain) -> DataFrame:
    """Ties among the best connected person and all direct partners."""
    shelf = Shelf(d.spark, "ego")
    near = shelf.put(hops(d, shelf, 1)[0].select("node"), "near")
    return ties(d).join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "shared")


_HOME = ", hp AS (SELECT person, studio, count(*) AS k FROM assign GROUP BY ALL), home AS (SELECT person, arg_max(studio, (k, studio)) AS h FROM hp GROUP BY person)"


def home(d: Domain) -> DataFrame:
    """(person, h): most frequent studio."""
    return assignments(d).groupBy("person", "studio").agg(_n().alias("k")).groupBy("person").agg(F.max_by("studio", F.struct("k", "studio")).alias("h"))


@R.query(_TIES + _MAIN + _HOME + ", g AS (SELECT nb.u AS b, h1.h AS hb, nb.v AS v, h2.h AS hv FROM nb JOIN home h1 ON h1.person = nb.u JOIN home h2 ON h2.person = nb.v), c AS (SELECT b, hb, hv, count(*) AS k FROM g GROUP BY ALL), t AS (SELECT b, sum(k) AS deg, coalesce(sum(CASE WHEN hv = hb THEN k END), 0) AS own, sum(k * k) AS sq, coalesce(sum(CASE WHEN hv <> hb THEN k * k END), 0) AS osq FROM c GROUP BY b) SELECT b AS person, CAST(own * (own - 1) // 2 AS BIGINT) AS coordinator, CAST((osq - (deg - own)) // 2 AS BIGINT) AS consultant, CAST(own * (deg - own) AS BIGINT) AS gatekeeper, CAST(((deg - own) * (deg - own) - osq) // 2 AS BIGINT) AS liaison FROM t")
def brokerage(d: Domain) -> DataFrame:
    """Neighbour pairs by the studios of broker and neighbours, from counts per studio instead of pairs."""
    h = home(d)
    g = both_ways(ties(d)).select("u", "v").join(h.withColumnsRenamed({"person": "u", "h": "hb"}), "u").join(h.withColumnsRenamed({"person": "v", "h": "hv"}), "v")
    c = g.groupBy("u", "hb", "hv").agg(_n().alias("k"))
    other = F.col("hv") != F.col("hb")
    t = c.groupBy("u").agg(F.sum("k").alias("deg"), F.coalesce(F.sum(F.when(~other, F.col("k"))), F.lit(0)).alias("own"), F.coalesce(F.sum(F.when(other, F.col("k") * F.col("k"))), F.lit(0)).alias("osq"))
    return t.select(F.col("u").alias("person"), F.expr("own * (own - 1) div 2").alias("coordinator"), F.expr("(osq - (deg - own)) div 2").alias("consultant"), F.expr("own * (deg - own)").alias("gatekeeper"), F.expr("((deg - own) * (deg - own) - osq) div 2").alias("liaison"))


@R.query(_MAIN + _YEAR + ", f AS (SELECT person, min(year) AS y0, min(year) FILTER (WHERE stage >= 4) AS yp FROM py GROUP BY person), d AS (SELECT a.studio, f.yp - f.y0 AS t FROM f JOIN assign a ON a.person = f.person AND a.year = f.y0 WHERE f.yp IS NOT NULL), m AS (SELECT median(t) AS m FROM d) SELECT studio, count(*) AS n, round(median(t) - any_value(m), 6) AS blockage FROM d CROSS JOIN m GROUP BY studio HAVING count(*) >= 3")
def studio_blockage(d: Domain) -> DataFrame:
    """Median years to promotion of a studio's debutants against all."""
    w = Window.partitionBy("person")
    f = person_years(d).withColumns({"y0": F.min("year").over(w), "yp": F.min(F.when(F.col("stage") >= 4, F.col("year"))).over(w)}).filter("year = y0 and yp is not null")
    x = f.join(assignments(d), ["person", "year"]).select("studio", (F.col("yp") - F.col("y0")).alias("t"))
    m = x.agg(F.percentile("t", F.lit(0.5)).alias("m"))
    return x.crossJoin(F.broadcast(m)).groupBy("studio").agg(_n().alias("n"), F.round(F.percentile("t", F.lit(0.5)) - F.max("m"), 6).alias("blockage")).filter("n >= 3")


_MENTOR = ", mw AS (SELECT c.work, c.person, max(stage) AS stage, max(year) AS year FROM crew c WHERE year IS NOT NULL GROUP BY ALL), mt AS (SELECT b.person AS mentee, min(b.year) AS e FROM mw a JOIN mw b ON a.work = b.work AND a.stage = 6 AND b.stage BETWEEN 1 AND 3 GROUP BY b.person)"


@R.query(_YEAR + _MENTOR + ", z AS (SELECT mt.mentee, avg(py.works) FILTER (WHERE py.year - mt.e BETWEEN -3 AND -1) AS before, avg(py.works) FILTER (WHERE py.year - mt.e BETWEEN 1 AND 5) AS after FROM mt JOIN py ON py.person = mt.mentee GROUP BY mt.mentee) SELECT count(*) AS n, round(avg(after - before), 6) AS mean, round(stddev_samp(after - before), 6) AS std, round(median(after - before), 6) AS median FROM z WHERE before IS NOT NULL AND after IS NOT NULL")
def mentor_effect(d: Domain) -> DataFrame:
    """Change of yearly works around the first work under a director."""
    mw = d.crew.filter("year is not null").groupBy("work", "person").agg(F.max("stage").alias("stage"), F.max("year").alias("year"))
    led = mw.filter("stage = 6").select("work").distinct()
    mt = mw.filter("stage between 1 and 3").join(led, "work", "left_semi").groupBy("person").agg(F.min("year").alias("e"))
    k = F.col("year") - F.col("e")
    z = person_years(d).join(mt, "person").groupBy("person").agg(F.avg(F.when(k.between(-3, -1), F.col("works"))).alias("b"), F.avg(F.when(k.between(1, 5), F.col("works"))).alias("a")).filter("a is not null and b is not null").select((F.col("a") - F.col("b")).alias("x"))
    return z.agg(_n().alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("median"))


@R.query(_TEAM_SQL + ", q AS (SELECT DISTINCT work FROM team WHERE work LIKE '%00'), sz AS (SELECT work, count(*) AS n FROM team GROUP BY work), x AS (SELECT a.work, b.work AS other, count(*) AS c FROM team a JOIN q ON q.work = a.work JOIN team b ON b.person = a.person AND b.work <> a.work GROUP BY ALL), s AS (SELECT x.work, x.other, round(c / (sa.n + sb.n - c), 9) AS j FROM x JOIN sz sa ON sa.work = x.work JOIN sz sb ON sb.work = x.other), k AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY j DESC, other) AS i FROM s) SELECT work, other, round(j, 6) AS overlap FROM k WHERE i <= 5")
def similar_works(d: Domain) -> DataFrame:
    """The five works with most similar staff for every hundredth work."""
    t = team(d).select("work", "person")
    size = t.groupBy("work").agg(_n().alias("n"))
    q = t.filter(F.col("work").like("%00"))
    x = q.join(t.withColumnRenamed("work", "other"), "person").filter("work <> other").groupBy("work", "other").agg(_n().alias("c"))
    x = x.join(size, "work").join(size.withColumnsRenamed({"work": "other", "n": "m"}), "other").withColumn("j", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 9))
    k = x.withColumn("i", F.row_number().over(Window.partitionBy("work").orderBy(F.desc("j"), "other"))).filter("i <= 5")
    return k.select("work", "other", F.round("j", 6).alias("overlap"))


@R.query(_TEAM_SQL + _TIES.replace(_TEAM_SQL, "", 1) + ", q AS (SELECT work, person FROM team WHERE core AND work LIKE '%00'), x AS (SELECT q.work, nb.v AS person, count(*) AS partners FROM q JOIN nb ON nb.u = q.person WHERE NOT EXISTS (SELECT 1 FROM team t WHERE t.work = q.work AND t.person = nb.v) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY partners DESC, person) AS i FROM x) SELECT work, person, partners FROM k WHERE i <= 5")
def team_recommendations(d: Domain) -> DataFrame:
    """Persons tied to most of a core team and not in it, for every hundredth work."""
    t = team(d)
    q = t.filter("core").filter(F.col("work").like("%00")).select("work", F.col("person").alias("u"))
    x = q.join(both_ways(ties(d)).select("u", F.col("v").alias("person")), "u").groupBy("work", "person").agg(_n().alias("partners")).join(t.select("work", "person"), ["work", "person"], "left_anti")
    return x.withColumn("i", F.row_number().over(Window.partitionBy("work").orderBy(F.desc("partners"), "person"))).filter("i <= 5").drop("i")


@R.query(_YEAR + " SELECT person, array_to_string(list(stage ORDER BY year), '') AS stages, count(*) AS years FROM py WHERE stage > 0 GROUP BY person HAVING count(*) >= 5")
def role_sequences(d: Domain) -> DataFrame:
    """Stages of a career's active years in order."""
    s = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("year", "stage"))), lambda x: x["stage"].cast("string")), "")
    return person_years(d).filter("stage > 0").groupBy("person").agg(s.alias("stages"), _n().alias("years")).filter("years >= 5")


@R.query(" SELECT work, " + " + ".join(f"CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN 1 ELSE 0 END" for c in ("title", "year", "season", "episodes", "duration", "format", "country")) + " AS filled FROM work")
def work_completeness(d: Domain) -> DataFrame:
    """Filled fields of each work, of seven."""
    has = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0)
    return d.work.select("work", sum((has(c) for c in ("title", "year", "season", "episodes", "duration", "format", "country")), F.lit(0)).alias("filled"))


@R.query(", b AS (SELECT source, lower(trim(id)) AS id, max(CASE WHEN coalesce(trim(title_ja), '') <> '' THEN 1 ELSE 0 END) AS t, max(CASE WHEN year BETWEEN 1900 AND 2100 THEN 1 ELSE 0 END) AS y, max(CASE WHEN len(studios) > 0 THEN 1 ELSE 0 END) AS s FROM bronze_anime GROUP BY ALL) SELECT source, count(*) AS ids, CAST(sum(t) AS BIGINT) AS with_title, CAST(sum(y) AS BIGINT) AS with_year, CAST(sum(s) AS BIGINT) AS with_studio FROM b GROUP BY source")
def bronze_coverage(d: Domain) -> DataFrame:
    b = d.raw("bronze_anime")
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    g = b.groupBy("source", F.lower(F.trim("id")).alias("id")).agg(has(F.coalesce(F.trim("title_ja"), F.lit("")) != "").alias("t"), has(F.col("year").between(1900, 2100)).alias("y"), has(F.size("studios") > 0).alias("s"))
    return g.groupBy("source").agg(_n().alias("ids"), F.sum("t").alias("with_title"), F.sum("y").alias("with_year"), F.sum("s").alias("with_studio"))


@R.query(", x AS (SELECT person, work, role, list(DISTINCT episode ORDER BY episode) AS e FROM crew WHERE episode IS NOT NULL GROUP BY ALL) SELECT person, work, role, CAST(len(e) AS INTEGER) AS episodes, e[1] AS first_episode, e[len(e)] AS last_episode FROM x")
def episode_spans(d: Domain) -> DataFrame:
    """Distinct episodes of each person, work and role."""
    return d.crew.filter("episode is not null").groupBy("person", "work", "role").agg(F.countDistinct("episode").cast("int").alias("episodes"), F.min("episode").alias("first_episode"), F.max("episode").alias("last_episode"))


@R.query()
def resilience(d: Domain) -> DataFrame:
    """Share of nodes in the largest component after removing those of which less than 0, 5, 10 and 20 % have more ties."""
    shelf = Shelf(d.spark, "resilience")
    e = shelf.put(ties(d).select("src", "dst"), "edges")
    deg = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(_n().alias("k"))
    count = deg.groupBy("k").agg(_n().alias("m"))  # one row a distinct degree
    w = Window.partitionBy(F.lit(1))
    above = F.coalesce(F.sum("m").over(w.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = shelf.put(deg.join(count.select("k", (above / F.sum("m").over(w)).alias("place")), "k"), "order")
    n, out = max(1, order.count()), []
    for share in (0.0, 0.05, 0.1, 0.2):
        keep = order.filter(F.col("place") >= share).select("node")
        left = e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
        top = components(left, Shelf(d.spark, "resilience")).groupBy("component").agg(_n().alias("n")).agg(F.max("n")).first()[0] or 0
        out.append((share, top, round(top / n, 6)))
    return d.spark.createDataFrame(out, "removed double, largest long, share double")


@R.query()
def community_spread(d: Domain) -> DataFrame:
    """Communities among a person's partners over their number."""
    return blocks.spread_of_ties(graph(d, Shelf(d.spark, "spread"), True)).select(F.col("node").alias("person"), "degree", F.round(F.col("communities") / F.col("degree"), 6).alias("spread"))


@R.query()
def label_episodes(d: Domain) -> DataFrame:
    """Episodes named in the raw role labels."""
    x = d.raw("credits").select("raw_role").filter("raw_role is not null").distinct()
    return x.select("raw_role", F.size(parse_episodes(F.col("raw_role"))).alias("episodes"))


QUERIES, SQL = R.queries, R.sql
