"""Persons, studios, works and teams: comparisons, similarity, chemistry, succession, and resolution of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import DIRECTORS, in_list
from .career_queries import _MAIN, _SPAN, _YEAR, LAST, assignments, person_years, spans
from .domain import Domain
from .network_queries import _GROUP, _TEAM, _nations, team
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")

_PRIME = ", pc AS (SELECT person, category, count(*) AS n FROM crew GROUP BY ALL), prime AS (SELECT person, arg_max(category, (n, category)) AS role FROM pc GROUP BY person)"


def prime(d: Domain) -> DataFrame:
    return d.crew.groupBy("person", "category").agg(_n().alias("n")).groupBy("person").agg(F.max_by("category", F.struct("n", "category")).alias("role"))


@R.query(_SPAN + _PRIME + ", b AS (SELECT s.person, p.role, CASE WHEN y1 - y0 < 5 THEN 0 WHEN y1 - y0 < 15 THEN 1 ELSE 2 END AS band, s.credits FROM span s JOIN prime p ON p.person = s.person), c AS (SELECT role, band, count(*) AS n FROM b GROUP BY ALL), sm AS (SELECT role, min(n) < 5 AS small FROM c GROUP BY role), z AS (SELECT b.person, b.role, CASE WHEN sm.small THEN -1 ELSE b.band END AS band, b.credits FROM b JOIN sm ON sm.role = b.role) SELECT person, role, band, round(100 * cume_dist() OVER (PARTITION BY role, band ORDER BY credits), 1) AS percentile FROM z")
def peer_percentile(d: Domain) -> DataFrame:
    """Percentile of credits among peers of role and career band; a role with a small band is one cohort."""
    years = F.col("y1") - F.col("y0")
    b = spans(d).join(prime(d), "person").select("person", "role", F.when(years < 5, 0).when(years < 15, 1).otherwise(2).alias("band"), "credits")
    small = b.groupBy("role", "band").agg(_n().alias("n")).groupBy("role").agg((F.min("n") < 5).alias("small"))
    z = b.join(small, "role").withColumn("band", F.when(F.col("small"), -1).otherwise(F.col("band")))
    h = z.groupBy("role", "band", "credits").agg(_n().alias("k"))
    w = Window.partitionBy("role", "band")
    h = h.select("role", "band", "credits", F.round(100 * F.sum("k").over(w.orderBy("credits")) / F.sum("k").over(w), 1).alias("percentile"))
    return z.join(h, ["role", "band", "credits"]).select("person", "role", "band", "percentile")


@R.query(_YEAR + ", f AS (SELECT person, min(year) AS y0, max(year) AS y1, count(*) AS k FROM py GROUP BY person), g AS (SELECT f.person, any_value(y0) AS y0, any_value(y1) AS y1, coalesce(sum(n) FILTER (WHERE year <= y0 + 2), 0) / 3.0 AS early, coalesce(sum(n) FILTER (WHERE year >= y1 - 2), 0) / 3.0 AS late, coalesce(sum(n) FILTER (WHERE year <= (y0 + y1) // 2), 0) AS h1, coalesce(sum(n) FILTER (WHERE year > (y0 + y1) // 2), 0) AS h2 FROM f JOIN py ON py.person = f.person GROUP BY f.person) SELECT person, round(CASE WHEN y1 > y0 THEN (late - early) / (y1 - y0) ELSE 0 END, 6) AS velocity, round(CASE WHEN y1 > y0 THEN (h2 - h1) * 1.0 / (y1 - y0) ELSE 0 END, 6) AS acceleration FROM g")
def growth_acceleration(d: Domain) -> DataFrame:
    w = Window.partitionBy("person")
    py = person_years(d).withColumns({"y0": F.min("year").over(w), "y1": F.max("year").over(w)})
    mid = F.expr("(y0 + y1) div 2")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = py.groupBy("person").agg(F.max("y0").alias("y0"), F.max("y1").alias("y1"), (s(F.col("year") <= F.col("y0") + 2) / 3.0).alias("early"), (s(F.col("year") >= F.col("y1") - 2) / 3.0).alias("late"), s(F.col("year") <= mid).alias("h1"), s(F.col("year") > mid).alias("h2"))
    span = F.col("y1") - F.col("y0")
    return g.select("person", F.round(F.when(span > 0, (F.col("late") - F.col("early")) / span).otherwise(0.0), 6).alias("velocity"), F.round(F.when(span > 0, (F.col("h2") - F.col("h1")) / span).otherwise(0.0), 6).alias("acceleration"))


@R.query(f", x AS (SELECT DISTINCT c.person, c.work, coalesce(nullif(w.format, ''), 'unknown') AS format, CASE WHEN w.episodes IS NULL THEN 'unknown' WHEN w.episodes <= 1 THEN 'single' WHEN w.episodes <= 13 THEN 'short' WHEN w.episodes <= 26 THEN 'middle' ELSE 'long' END AS scale FROM crew c JOIN work w ON w.work = c.work WHERE c.role IN {in_list(DIRECTORS)}), k AS (SELECT person FROM x GROUP BY person HAVING count(*) >= 3) SELECT x.person, format, scale, count(*) AS n FROM x JOIN k ON k.person = x.person GROUP BY ALL")
def director_scale_profiles(d: Domain) -> DataFrame:
    e = F.col("episodes")
    scale = F.when(e.isNull(), "unknown").when(e <= 1, "single").when(e <= 13, "short").when(e <= 26, "middle").otherwise("long")
    x = d.crew.filter(F.col("role").isin(*DIRECTORS)).select("person", "work").distinct().join(d.work.select("work", F.coalesce(F.nullif(F.col("format"), F.lit("")), F.lit("unknown")).alias("format"), scale.alias("scale")), "work")
    k = x.groupBy("person").agg(_n().alias("k")).filter("k >= 3").select("person")
    return x.join(k, "person", "left_semi").groupBy("person", "format", "scale").agg(_n().alias("n"))


@R.query(_SPAN + ", v AS (SELECT person, credits AS a, active * 1.0 / (y1 - y0 + 1) AS b FROM span), m AS (SELECT count(*) AS m FROM v), r AS (SELECT person, (rank() OVER (ORDER BY b) - 1) * 1.0 / (m - 1) * 99 AS rb, (rank() OVER (ORDER BY a) - 1) * 1.0 / (m - 1) * 99 AS ra FROM v CROSS JOIN m) SELECT person, round(rb - ra, 4) AS undervaluation, rb - ra >= 30 AS structural FROM r")
def undervaluation(d: Domain) -> DataFrame:
    """Rank of activity minus rank of credits; ranks come from counts of distinct values."""
    v = spans(d).select("person", F.col("credits").alias("a"), (F.col("active") * 1.0 / (F.col("y1") - F.col("y0") + 1)).alias("b"))
    m = v.agg(_n().alias("m"))

    def left_rank(c: str) -> DataFrame:
        h = v.groupBy(c).agg(_n().alias("k"))
        return h.select(c, F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"r{c}"))

    x = v.join(left_rank("a"), "a").join(left_rank("b"), "b").crossJoin(F.broadcast(m))
    s = (F.col("rb") - F.col("ra")) / (F.col("m") - 1) * 99
    return x.select("person", F.round(F.col("rb") / (F.col("m") - 1) * 99 - F.col("ra") / (F.col("m") - 1) * 99, 4).alias("undervaluation"), (s >= 30).alias("structural"))


@R.query(_TEAM + ", sz AS (SELECT work, ln(1 + count(*)) AS y FROM team GROUP BY work), mu AS (SELECT avg(y) AS m FROM sz), p AS (SELECT a.person AS person_a, b.person AS person_b, count(*) AS n, avg(sz.y - mu.m) AS mean, stddev_samp(sz.y - mu.m) AS sd FROM team a JOIN team b ON a.work = b.work AND a.person < b.person AND a.core AND b.core JOIN sz ON sz.work = a.work CROSS JOIN mu GROUP BY ALL HAVING count(*) >= 3) SELECT person_a, person_b, n, round(mean, 6) AS mean, round(CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END, 4) AS t FROM p")
def team_chemistry(d: Domain) -> DataFrame:
    """Core pairs with at least three works: mean deviation of the work's log size and its t value."""
    t = team(d)
    sz = t.groupBy("work").agg(F.log1p(_n()).alias("y"))
    mu = sz.agg(F.avg("y").alias("m"))
    c = t.filter("core").join(sz.crossJoin(F.broadcast(mu)), "work").select("work", "person", (F.col("y") - F.col("m")).alias("r"))
    a, b = c.select("work", F.col("person").alias("person_a"), "r"), c.select("work", F.col("person").alias("person_b"))
    p = a.join(b, "work").filter("person_a < person_b").groupBy("person_a", "person_b").agg(_n().alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")).filter("n >= 3")
    return p.select("person_a", "person_b", "n", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))), 4).alias("t"))


@R.query(_TEAM + ", s AS (SELECT work, count(*) AS staff FROM team GROUP BY work HAVING count(*) >= 15), r AS (SELECT DISTINCT c.work, c.category FROM crew c JOIN s ON s.work = c.work) SELECT a.category AS role_a, b.category AS role_b, count(*) AS n FROM r a JOIN r b ON a.work = b.work AND a.category < b.category GROUP BY ALL ORDER BY n DESC, role_a, role_b LIMIT 20")
def role_pairs(d: Domain) -> DataFrame:
    """Report of the 20 most frequent pairs of role groups in large teams."""
    s = team(d).groupBy("work").agg(_n().alias("staff")).filter("staff >= 15").select("work")
    r = d.crew.select("work", "category").distinct().join(s, "work", "left_semi")
    a, b = r.select("work", F.col("category").alias("role_a")), r.select("work", F.col("category").alias("role_b"))
    return a.join(b, "work").filter("role_a < role_b").groupBy("role_a", "role_b").agg(_n().alias("n")).orderBy(F.desc("n"), "role_a", "role_b").limit(20)


@R.query(_SPAN + _PRIME + ", v AS (SELECT s.person, p.role, ln(1 + credits) AS a, CAST(active AS DOUBLE) AS b, CAST(top AS DOUBLE) AS c FROM span s JOIN prime p ON p.person = s.person), q AS (SELECT * FROM v WHERE person LIKE '%00'), x AS (SELECT q.person, v.person AS other, round((q.a * v.a + q.b * v.b + q.c * v.c) / (sqrt(q.a * q.a + q.b * q.b + q.c * q.c) * sqrt(v.a * v.a + v.b * v.b + v.c * v.c)), 9) AS s FROM q JOIN v ON v.role = q.role AND v.person <> q.person), k AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY s DESC, other) AS i FROM x) SELECT person, other, round(s, 6) AS similarity FROM k WHERE i <= 5")
def similar_persons(d: Domain) -> DataFrame:
    """The five most similar persons of the same role for every hundredth person: a top-k report over a stated set of queries."""
    v = spans(d).join(prime(d), "person").select("person", "role", F.log1p("credits").alias("a"), F.col("active").cast("double").alias("b"), F.col("top").cast("double").alias("c"))
    v = v.withColumn("norm", F.sqrt(sum((F.col(x) * F.col(x) for x in "abc"), F.lit(0.0))))
    q = v.filter(F.col("person").like("%00")).select("role", F.col("person").alias("asked"), *[F.col(x).alias(f"q{x}") for x in ("a", "b", "c", "norm")])
    dot = sum((F.col(x) * F.col(f"q{x}") for x in "abc"), F.lit(0.0))
    x = v.join(q, "role").filter("person <> asked").select(F.col("asked").alias("person"), F.col("person").alias("other"), F.round(dot / (F.col("norm") * F.col("qnorm")), 9).alias("s"))
    k = x.withColumn("i", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("s"), "other"))).filter("i <= 5")
    return k.select("person", "other", F.round("s", 6).alias("similarity"))


@R.query(_MAIN + ", p AS (SELECT person, studio, count(*) AS n FROM assign GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY person) AS s, count(*) OVER (PARTITION BY person) AS k FROM p) SELECT person, count(*) AS studios, round(sum(s * s), 6) AS concentration, round(CASE WHEN count(*) > 1 THEN -sum(s * log2(s)) / log2(count(*)) ELSE 0.0 END, 6) AS diversity FROM t GROUP BY person")
def studio_bias(d: Domain) -> DataFrame:
    """Concentration and diversity of the studios a person works for."""
    p = assignments(d).groupBy("person", "studio").agg(_n().alias("n"))
    t = p.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("person")))
    h = F.when(_n() > 1, -F.sum(F.col("s") * F.log2("s")) / F.log2(_n())).otherwise(0.0)
    return t.groupBy("person").agg(_n().alias("studios"), F.round(F.sum(F.col("s") * F.col("s")), 6).alias("concentration"), F.round(h, 6).alias("diversity"))


@R.query(_MAIN + _YEAR + ", p AS (SELECT studio, person, count(*) AS k FROM assign GROUP BY ALL), m AS (SELECT person, arg_max(studio, (k, studio)) AS studio FROM p GROUP BY person), x AS (SELECT m.studio, ln(1 + sum(py.n)) AS v FROM m JOIN py ON py.person = m.person GROUP BY m.studio, m.person) SELECT studio, count(*) AS persons, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM x GROUP BY studio HAVING count(*) >= 5")
def talent_density(d: Domain) -> DataFrame:
    """Distribution of log credits of each studio's persons (by most frequent studio)."""
    m = assignments(d).groupBy("person", "studio").agg(_n().alias("k")).groupBy("person").agg(F.max_by("studio", F.struct("k", "studio")).alias("studio"))
    x = person_years(d).groupBy("person").agg(F.log1p(F.sum("n")).alias("v")).join(m, "person")
    q = lambda p: F.percentile("v", F.lit(p))
    return x.groupBy("studio").agg(_n().alias("persons"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(q(0.5), 6).alias("median"), F.round(q(0.75) - q(0.25), 6).alias("iqr")).filter("persons >= 5")


@R.query(" SELECT s.studio, count(DISTINCT s.work) AS works, count(DISTINCT c.person) AS persons, count(*) AS credits, min(c.year) AS first_year, max(c.year) AS last_year FROM studio s JOIN crew c ON c.work = s.work GROUP BY s.studio")
def studio_profile(d: Domain) -> DataFrame:
    return d.studio.join(d.crew, "work").groupBy("studio").agg(F.countDistinct("work").alias("works"), F.countDistinct("person").alias("persons"), _n().alias("credits"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@R.query(", t AS (SELECT s.studio, c.person, count(*) AS n FROM studio s JOIN crew c ON c.work = s.work GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY studio ORDER BY n DESC, person) AS i FROM t) SELECT studio, person, n, CAST(i AS INTEGER) AS place FROM k WHERE i <= 10")
def studio_top_persons(d: Domain) -> DataFrame:
    """Report of the ten persons with most credits per studio."""
    t = d.studio.join(d.crew, "work").groupBy("studio", "person").agg(_n().alias("n"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("studio").orderBy(F.desc("n"), "person"))).filter("place <= 10")


@R.query(_MAIN + _YEAR + ", f AS (SELECT person, min(year) AS y0, max(stage) AS top, min(year) FILTER (WHERE stage >= 4) AS yp FROM py GROUP BY person), j AS (SELECT py.person FROM py JOIN f ON f.person = py.person AND f.y0 = py.year WHERE py.stage <= 2), d AS (SELECT a.person, a.studio FROM assign a JOIN f ON f.person = a.person AND f.y0 = a.year) SELECT d.studio, count(*) AS juniors, count(*) FILTER (WHERE f.top >= 4) AS promoted, round(avg(f.yp - f.y0), 6) AS mean_years FROM j JOIN d ON d.person = j.person JOIN f ON f.person = j.person GROUP BY d.studio")
def talent_pipeline(d: Domain) -> DataFrame:
    """Juniors who started at a studio and how many were promoted."""
    w = Window.partitionBy("person")
    py = person_years(d).withColumns({"y0": F.min("year").over(w), "top": F.max("stage").over(w), "yp": F.min(F.when(F.col("stage") >= 4, F.col("year"))).over(w)})
    j = py.filter("year = y0 and stage <= 2").join(assignments(d), ["person", "year"])
    return j.groupBy("studio").agg(_n().alias("juniors"), F.count_if(F.col("top") >= 4).alias("promoted"), F.round(F.avg(F.col("yp") - F.col("y0")), 6).alias("mean_years"))


@R.query(_YEAR + ", q AS (SELECT person, n, row_number() OVER (PARTITION BY person ORDER BY year DESC) AS k, year FROM py), s AS (SELECT person, max(year) AS y1, min(year) AS y0 FROM py GROUP BY person), c AS (SELECT person, max(n) AS m FROM py GROUP BY person), l AS (SELECT q.person, regr_slope(q.n, -q.k) AS slope FROM q WHERE k <= 3 GROUP BY q.person) SELECT s.person, s.y1 - s.y0 AS years, round(1 / (1 + exp(-(s.y1 - s.y0 - 25.0))) * (1 - (least(greatest(coalesce(l.slope, 0) / c.m, -1.0), 1.0) + 1) / 2), 6) AS risk FROM s JOIN c ON c.person = s.person JOIN l ON l.person = s.person")
def retirement_risk(d: Domain) -> DataFrame:
    """Risk from career length and the slope of the last three active years."""
    k = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("year")))
    q = person_years(d).withColumn("k", k)
    last = F.col("k") <= 3
    g = q.groupBy("person").agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.max("n").alias("m"), F.regr_slope(F.when(last, F.col("n")), F.when(last, -F.col("k"))).alias("slope"))
    s = F.least(F.greatest(F.coalesce("slope", F.lit(0.0)) / F.col("m"), F.lit(-1.0)), F.lit(1.0))
    years = F.col("y1") - F.col("y0")
    return g.select("person", years.alias("years"), F.round(1 / (1 + F.exp(-(years - 25.0))) * (1 - (s + 1) / 2), 6).alias("risk"))


@R.query(_YEAR + ", g AS (SELECT person, year, n, lag(n) OVER (PARTITION BY person ORDER BY year) AS before FROM py) SELECT person, year, round((n - before) * 1.0 / before, 6) AS change, CASE WHEN n > 2 * before THEN 'surge' ELSE 'drop' END AS kind FROM g WHERE before IS NOT NULL AND (n > 2 * before OR n < 0.5 * before)")
def turning_points(d: Domain) -> DataFrame:
    """Years in which a person's credits more than doubled or halved."""
    g = person_years(d).withColumn("before", F.lag("n").over(Window.partitionBy("person").orderBy("year"))).filter("before is not null and (n > 2 * before or n < 0.5 * before)")
    return g.select("person", "year", F.round((F.col("n") - F.col("before")) / F.col("before"), 6).alias("change"), F.when(F.col("n") > 2 * F.col("before"), "surge").otherwise("drop").alias("kind"))


@R.query(_YEAR + ", x AS (SELECT person, year, lag(year) OVER (PARTITION BY person ORDER BY year) AS before FROM py) SELECT person, before AS gap_start, year AS gap_end, year - before AS length FROM x WHERE year - before >= 3 UNION ALL SELECT person, max(year), NULL, 2025 - max(year) FROM py GROUP BY person HAVING 2025 - max(year) >= 3")
def career_gaps(d: Domain) -> DataFrame:
    """Gaps of three years or more; the end is null while a gap is open."""
    py = person_years(d)
    x = py.withColumn("before", F.lag("year").over(Window.partitionBy("person").orderBy("year"))).filter("year - before >= 3").select("person", F.col("before").alias("gap_start"), F.col("year").alias("gap_end"), (F.col("year") - F.col("before")).alias("length"))
    o = py.groupBy("person").agg(F.max("year").alias("gap_start")).filter(F.lit(LAST) - F.col("gap_start") >= 3)
    return x.unionByName(o.select("person", "gap_start", F.lit(None).cast("int").alias("gap_end"), (LAST - F.col("gap_start")).alias("length")))


@R.query(_GROUP + _SPAN.replace(", py AS", ", py AS", 1) + " SELECT coalesce(n.grp, 'UNK') AS grp, count(*) AS persons, round(avg(ln(1 + s.credits)), 6) AS mean_log_credits, round(avg(s.top), 6) AS mean_stage FROM span s LEFT JOIN natl n ON n.person = s.person GROUP BY 1")
def nationality_profile(d: Domain) -> DataFrame:
    s = spans(d).join(_nations(d), "person", "left")
    return s.groupBy(F.coalesce("grp", F.lit("UNK")).alias("grp")).agg(_n().alias("persons"), F.round(F.avg(F.log1p("credits")), 6).alias("mean_log_credits"), F.round(F.avg("top"), 6).alias("mean_stage"))


@R.query(", w AS (SELECT min(year) AS lo, max(year) AS hi FROM crew), p AS (SELECT DISTINCT person, year, category FROM crew WHERE year IS NOT NULL), x AS (SELECT p.person, p.category, CAST(s AS INTEGER) AS start FROM p CROSS JOIN w, unnest(generate_series(CAST(floor((p.year - 4) / 2.0) * 2 AS BIGINT), CAST(floor(p.year / 2.0) * 2 AS BIGINT), 2)) AS t(s) WHERE s <= p.year AND s + 4 >= p.year) SELECT start, category, count(DISTINCT person) AS persons FROM x GROUP BY ALL")
def sliding_activity(d: Domain) -> DataFrame:
    """Persons by role group in windows of five years that start every second year."""
    p = d.crew.filter("year is not null").select("person", "year", "category").distinct()
    last = (F.floor(F.col("year") / 2.0) * 2).cast("int")
    x = p.select("person", "category", F.explode(F.filter(F.array(last - 4, last - 2, last), lambda s: s + 4 >= F.col("year"))).alias("start"))
    return x.groupBy("start", "category").agg(F.countDistinct("person").alias("persons"))


@R.query(", v AS (SELECT lower(trim(canonical_id)) AS id, lower(trim(title_ja, ' ')) AS title, CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year FROM anime WHERE trim(title_ja, ' ') <> ''), b AS (SELECT lower(trim(id)) AS raw, lower(trim(title_ja, ' ')) AS title, CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year FROM bronze_anime WHERE trim(title_ja, ' ') <> ''), m AS (SELECT DISTINCT b.raw, v.id FROM b JOIN v ON v.title = b.title AND (b.year IS NULL OR v.year IS NULL OR abs(b.year - v.year) <= 1)), k AS (SELECT raw, count(*) AS n, min(id) AS id FROM m GROUP BY raw) SELECT raw, CASE WHEN n = 1 THEN id END AS id, n AS candidates FROM k")
def exact_title_matches(d: Domain) -> DataFrame:
    """Raw records by equal title and year within one; an id only where it is the only one."""
    ok = lambda c: F.when(F.col(c).between(1900, 2100), F.col(c))
    v = d.raw("anime").filter("trim(title_ja) <> ''").select(F.lower(F.trim("canonical_id")).alias("id"), F.lower(F.trim("title_ja")).alias("title"), ok("year").alias("y"))
    b = d.raw("bronze_anime").filter("trim(title_ja) <> ''").select(F.lower(F.trim("id")).alias("raw"), F.lower(F.trim("title_ja")).alias("title"), ok("year").alias("yb"))
    m = b.join(v, "title").filter(F.coalesce(F.abs(F.col("y") - F.col("yb")) <= 1, F.lit(True))).select("raw", "id").distinct()
    return m.groupBy("raw").agg(F.when(_n() == 1, F.min("id")).alias("id"), _n().alias("candidates"))


@R.query(", p AS (SELECT person, lower(regexp_replace(coalesce(name_en, ''), '[^A-Za-z]+', '', 'g')) AS name FROM person), b AS (SELECT person, name, split_part(person, ':', 1) AS src, substr(name, 1, 3) AS k FROM p WHERE length(name) >= 5) SELECT a.person AS person_a, b.person AS person_b, levenshtein(a.name, b.name) AS edits FROM b a JOIN b ON a.k = b.k AND a.src = b.src AND a.person < b.person AND abs(length(a.name) - length(b.name)) <= 1 WHERE a.name <> b.name AND levenshtein(a.name, b.name) <= 1")
def similar_names(d: Domain) -> DataFrame:
    """Names one edit apart within a source, blocked by the first three letters."""
    b = d.person.select("person", F.lower(F.regexp_replace(F.coalesce("name_en", F.lit("")), "[^A-Za-z]+", "")).alias("name")).filter("length(name) >= 5")
    b = b.withColumns({"src": F.split_part("person", F.lit(":"), F.lit(1)), "k": F.substring("name", 1, 3)})
    x, y = (b.select("src", "k", F.col("person").alias(f"person_{c}"), F.col("name").alias(f"name_{c}")) for c in "ab")
    e = F.levenshtein("name_a", "name_b", 1)
    return x.join(y, ["src", "k"]).filter((F.col("person_a") < F.col("person_b")) & (F.col("name_a") != F.col("name_b")) & (F.abs(F.length("name_a") - F.length("name_b")) <= 1)).withColumn("edits", e.cast("bigint")).filter("edits between 0 and 1").select("person_a", "person_b", "edits")


@R.query(", x AS (SELECT nullif(regexp_extract(raw_role, '(\\d+)\\s*[-~〜]\\s*(\\d+)', 1), '') AS a, nullif(regexp_extract(raw_role, '(\\d+)\\s*[-~〜]\\s*(\\d+)', 2), '') AS b, raw_role FROM credits WHERE raw_role IS NOT NULL) SELECT lower(trim(raw_role)) AS label, count(*) AS n, count(a) AS with_range FROM x GROUP BY 1")
def role_labels(d: Domain) -> DataFrame:
    """Raw role labels with their counts."""
    return d.raw("credits").filter("raw_role is not null").groupBy(F.lower(F.trim("raw_role")).alias("label")).agg(_n().alias("n"), F.count_if(F.col("raw_role").rlike(r"(\d+)\s*[-~〜]\s*(\d+)")).alias("with_range"))


@R.query(" SELECT label, count(*) AS n, round(avg(e), 6) AS first_mean, round(max(e), 6) AS first_max FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS e FROM embeddings) GROUP BY label")
def embedding_stats(d: Domain) -> DataFrame:
    e = F.element_at("embedding", 1).cast("double")
    return d.raw("embeddings").groupBy("label").agg(_n().alias("n"), F.round(F.avg(e), 6).alias("first_mean"), F.round(F.max(e), 6).alias("first_max"))


@R.query(", q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT q.vec_id, e.vec_id AS other, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS i FROM x) SELECT vec_id, other, round(s, 6) AS similarity FROM k WHERE i <= 10")
def nearest_vectors(d: Domain) -> DataFrame:
    """The ten nearest vectors of every hundredth one, against all rows; the query set is joined in blocks."""
    v = d.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = v.withColumn("norm", F.sqrt(dot("v", "v")))
    blocks = 8
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("asked"), F.col("v").alias("qv"), F.col("norm").alias("qn"), F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("block"))
    x = v.withColumn("block", F.pmod(F.hash("vec_id"), F.lit(blocks))).join(q, "block").filter("vec_id <> asked")
    x = x.select(F.col("asked").alias("vec_id"), F.col("vec_id").alias("other"), F.round(dot("v", "qv") / (F.col("norm") * F.col("qn")), 9).alias("s"))
    k = x.withColumn("i", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "other"))).filter("i <= 10")
    return k.select("vec_id", "other", F.round("s", 6).alias("similarity"))


QUERIES, SQL = R.queries, R.sql
