"""Readers, precomputed features and per-entity statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import DIRECTORS, in_list
from .domain import Domain
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")


@R.query(", x AS (SELECT work, list(studio ORDER BY main DESC, studio) AS s FROM studio GROUP BY work) SELECT w.work, w.year, w.episodes, coalesce(array_to_string(x.s, ','), '') AS studios FROM work w LEFT JOIN x ON x.work = w.work")
def works_with_studios(d: Domain) -> DataFrame:
    """Each work with its studios, main ones first."""
    s = d.studio.groupBy("work").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((~F.col("main")).alias("k"), "studio"))), lambda x: x["studio"]), ",").alias("studios"))
    return d.work.join(s, "work", "left").select("work", "year", "episodes", F.coalesce("studios", F.lit("")).alias("studios"))


@R.query(" SELECT person, year, role, count(DISTINCT work) AS n_works, count(*) AS n_credits FROM credit GROUP BY ALL")
def credits_per_person(d: Domain) -> DataFrame:
    return d.credit.groupBy("person", "year", "role").agg(F.countDistinct("work").alias("n_works"), _n().alias("n_credits"))


@R.query(", p AS (SELECT DISTINCT work, person FROM crew) SELECT a.person, count(DISTINCT b.person) AS n_collaborators FROM p a JOIN p b ON a.work = b.work AND a.person <> b.person GROUP BY a.person")
def collaborator_counts(d: Domain) -> DataFrame:
    p = d.crew.select("work", "person").distinct()
    return p.join(p.withColumnRenamed("person", "other"), "work").filter("person <> other").groupBy("person").agg(F.countDistinct("other").alias("n_collaborators"))


@R.query(f", dir AS (SELECT DISTINCT work, person AS director FROM crew WHERE role IN {in_list(DIRECTORS)}) SELECT c.person, dir.director, count(DISTINCT c.work) AS n_works FROM crew c JOIN dir ON dir.work = c.work AND dir.director <> c.person GROUP BY ALL")
def patronage_collaborations(d: Domain) -> DataFrame:
    lead = d.crew.filter(F.col("role").isin(*DIRECTORS)).select("work", F.col("person").alias("director")).distinct()
    return d.crew.select("work", "person").distinct().join(lead, "work").filter("person <> director").groupBy("person", "director").agg(_n().alias("n_works"))


@R.query(""", q AS (SELECT DISTINCT person, year * 4 + coalesce(quarter, 2) - 1 AS t FROM crew WHERE year IS NOT NULL),
g AS (SELECT person, t, t - lag(t) OVER (PARTITION BY person ORDER BY t) AS gap FROM q)
SELECT person, count(*) AS active_quarters, min(t) AS first_quarter, max(t) AS last_quarter, CASE WHEN count(*) = 1 THEN 1.0 ELSE round(count(*) / (max(t) - min(t) + 1), 6) END AS density,
round(avg(gap), 6) AS mean_gap, round(median(gap), 6) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap, round(CASE WHEN count(gap) < 2 THEN 0.0 ELSE stddev_samp(gap) END, 6) AS std_gap,
count(*) FILTER (WHERE gap = 1) AS consecutive, count(*) FILTER (WHERE gap >= 4) AS long_gaps FROM g GROUP BY person""")
def feat_credit_activity(d: Domain) -> DataFrame:
    """Quarterly activity and gaps of each person."""
    q = d.crew.filter("year is not null").select("person", (F.col("year") * 4 + F.coalesce("quarter", F.lit(2)) - 1).alias("t")).distinct()
    g = q.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("person").orderBy("t")))
    return g.groupBy("person").agg(
        _n().alias("active_quarters"), F.min("t").alias("first_quarter"), F.max("t").alias("last_quarter"),
        F.when(_n() == 1, 1.0).otherwise(F.round(_n() / (F.max("t") - F.min("t") + 1), 6)).alias("density"),
        F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        F.round(F.when(F.count("gap") < 2, 0.0).otherwise(F.stddev_samp("gap")), 6).alias("std_gap"),
        F.count_if(F.col("gap") == 1).alias("consecutive"), F.count_if(F.col("gap") >= 4).alias("long_gaps"),
    )


_CATS = ("direction", "animation_supervision", "animation", "design", "technical", "art", "sound", "writing", "production", "production_management", "finishing", "editing", "settings")


@R.query(", x AS (SELECT person, year, role, category, count(DISTINCT work) AS n_works, count(*) AS n_credits FROM credit WHERE year IS NOT NULL GROUP BY ALL), f AS (SELECT person, min(year) AS debut FROM x GROUP BY person) SELECT x.person, x.year, x.year - f.debut AS career_year, CAST(sum(n_works) AS BIGINT) AS n_works, CAST(sum(n_credits) AS BIGINT) AS n_credits, count(DISTINCT role) AS n_roles, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN category = '{c}' THEN n_works END), 0) AS BIGINT) AS works_{c}" for c in _CATS) + " FROM x JOIN f ON f.person = x.person GROUP BY ALL")
def feat_career_annual(d: Domain) -> DataFrame:
    """Works and credits of each person and year by category; works count once per role."""
    x = d.credit.filter("year is not null").groupBy("person", "year", "role", "category").agg(F.countDistinct("work").alias("n_works"), _n().alias("n_credits"))
    y = x.groupBy("person", "year").agg(F.sum("n_works").alias("n_works"), F.sum("n_credits").alias("n_credits"), _n().alias("n_roles"), *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n_works"))), F.lit(0)).alias(f"works_{c}") for c in _CATS])
    return y.withColumn("career_year", F.col("year") - F.min("year").over(Window.partitionBy("person")))


@R.query(""", x AS (SELECT person, role, year, count(DISTINCT work) AS n FROM crew WHERE year IS NOT NULL GROUP BY ALL),
p AS (SELECT person, role, year AS peak_year, n AS peak_works FROM (SELECT *, row_number() OVER (PARTITION BY person, role ORDER BY n DESC, year DESC) AS k FROM x) WHERE k = 1),
f AS (SELECT person, min(year) AS debut FROM x GROUP BY person)
SELECT x.person, x.role, min(x.year) AS first_year, max(x.year) AS last_year, CAST(sum(n) AS BIGINT) AS n_works, any_value(peak_year) AS peak_year, any_value(peak_works) AS peak_works, min(x.year) - any_value(debut) AS years_to_role
FROM x JOIN p ON p.person = x.person AND p.role = x.role JOIN f ON f.person = x.person GROUP BY x.person, x.role""")
def feat_role_progression(d: Domain) -> DataFrame:
    """First, last and peak year of each person and role."""
    x = d.crew.filter("year is not null").groupBy("person", "role", "year").agg(F.countDistinct("work").alias("n"))
    y = x.groupBy("person", "role").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("n").alias("n_works"), F.max(F.struct("n", "year")).alias("p"))
    debut = F.min("first_year").over(Window.partitionBy("person"))
    return y.select("person", "role", "first_year", "last_year", "n_works", F.col("p.year").alias("peak_year"), F.col("p.n").alias("peak_works"), (F.col("first_year") - debut).alias("years_to_role"))


@R.query(" SELECT c.person, s.studio, count(DISTINCT c.work) AS n_works, count(*) AS n_credits, min(c.year) AS first_year, max(c.year) AS last_year, max(s.main) AS ever_main FROM crew c JOIN studio s ON s.work = c.work GROUP BY ALL")
def feat_studio_affiliation(d: Domain) -> DataFrame:
    return d.crew.join(d.studio, "work").groupBy("person", "studio").agg(F.countDistinct("work").alias("n_works"), _n().alias("n_credits"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max("main").alias("ever_main"))


@R.query(" SELECT person, count(*) AS n_credits, count(DISTINCT work) AS n_works, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS active_years, max(stage) AS highest_stage, arg_max(role, (stage, role)) AS highest_role FROM crew GROUP BY person")
def career_summary(d: Domain) -> DataFrame:
    return d.crew.groupBy("person").agg(_n().alias("n_credits"), F.countDistinct("work").alias("n_works"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("active_years"), F.max("stage").alias("highest_stage"), F.max_by("role", F.struct("stage", "role")).alias("highest_role"))


@R.query(""", y AS (SELECT person, year, count(*) AS n FROM crew WHERE year IS NOT NULL GROUP BY ALL)
SELECT person, CAST(sum(n) AS BIGINT) AS credits, round(sum(n) / (max(year) - min(year) + 1), 6) AS credits_per_year, round(count(*) / (max(year) - min(year) + 1), 6) AS activity, arg_max(year, (n, -year)) AS peak_year, max(n) AS peak_credits FROM y GROUP BY person""")
def productivity(d: Domain) -> DataFrame:
    y = d.crew.filter("year is not null").groupBy("person", "year").agg(_n().alias("n"))
    span = F.max("year") - F.min("year") + 1
    return y.groupBy("person").agg(F.sum("n").alias("credits"), F.round(F.sum("n") / span, 6).alias("credits_per_year"), F.round(_n() / span, 6).alias("activity"), F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.max("n").alias("peak_credits"))


@R.query(" SELECT person, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, round(least(count(DISTINCT category) / 4.0, 1.0) * 100, 6) AS versatility FROM crew GROUP BY person")
def versatility(d: Domain) -> DataFrame:
    return d.crew.groupBy("person").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"), F.round(F.least(F.countDistinct("category") / 4.0, F.lit(1.0)) * 100, 6).alias("versatility"))


@R.query(", x AS (SELECT person, role, count(*) AS n FROM crew GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY person) AS p FROM x) SELECT person, count(*) AS n_roles, round(CASE WHEN count(*) <= 1 THEN 0.0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS role_entropy FROM t GROUP BY person")
def role_diversity(d: Domain) -> DataFrame:
    x = d.crew.groupBy("person", "role").agg(_n().alias("n"))
    t = x.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("person")))
    return t.groupBy("person").agg(_n().alias("n_roles"), F.round(F.when(_n() <= 1, 0.0).otherwise(-F.sum(F.col("p") * F.log("p")) / F.log(_n())), 6).alias("role_entropy"))


@R.query(" SELECT c.work, any_value(w.year) AS year, count(*) AS n_credits, count(DISTINCT person) AS n_persons, count(DISTINCT role) AS n_roles, round(sum(weight), 6) AS weight FROM crew c JOIN work w ON w.work = c.work GROUP BY c.work")
def work_stats(d: Domain) -> DataFrame:
    c = d.crew.groupBy("work").agg(_n().alias("n_credits"), F.countDistinct("person").alias("n_persons"), F.countDistinct("role").alias("n_roles"), F.round(F.sum("weight"), 6).alias("weight"))
    return c.join(d.work.select("work", "year"), "work")


@R.query(" SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, count(*) AS n_credits, count(DISTINCT person) AS n_persons, count(DISTINCT work) AS n_works, round(count(DISTINCT (work, person)) / count(DISTINCT work), 6) AS mean_staff FROM crew WHERE year IS NOT NULL GROUP BY 1")
def decades(d: Domain) -> DataFrame:
    c = d.crew.filter("year is not null").withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    return c.groupBy("decade").agg(_n().alias("n_credits"), F.countDistinct("person").alias("n_persons"), F.countDistinct("work").alias("n_works"), F.round(F.countDistinct("work", "person") / F.countDistinct("work"), 6).alias("mean_staff"))


@R.query(" SELECT w.season, count(DISTINCT c.work) AS n_works, count(DISTINCT c.person) AS n_persons, count(*) AS n_credits FROM crew c JOIN work w ON w.work = c.work WHERE w.season IS NOT NULL GROUP BY 1")
def seasons(d: Domain) -> DataFrame:
    return d.crew.join(d.work.select("work", "season"), "work").filter("season is not null").groupBy("season").agg(F.countDistinct("work").alias("n_works"), F.countDistinct("person").alias("n_persons"), _n().alias("n_credits"))


@R.query(" SELECT c.person, " + ", ".join(f"count(*) FILTER (WHERE w.season = '{s}') AS {s}" for s in ("winter", "spring", "summer", "fall")) + " FROM crew c JOIN work w ON w.work = c.work WHERE w.season IS NOT NULL GROUP BY c.person")
def person_seasons(d: Domain) -> DataFrame:
    c = d.crew.join(d.work.select("work", "season"), "work").filter("season is not null")
    return c.groupBy("person").agg(*[F.count_if(F.col("season") == s).alias(s) for s in ("winter", "spring", "summer", "fall")])


@R.query(", f AS (SELECT person, min(year) AS debut FROM crew GROUP BY person) SELECT c.year, count(*) AS n_credits, count(DISTINCT c.person) AS n_persons, count(DISTINCT c.work) AS n_works, count(DISTINCT CASE WHEN f.debut = c.year THEN c.person END) AS newcomers FROM crew c JOIN f ON f.person = c.person WHERE c.year IS NOT NULL GROUP BY c.year")
def time_series(d: Domain) -> DataFrame:
    c = d.crew.filter("year is not null").select("person", "work", "year")
    f = c.groupBy("person").agg(F.min("year").alias("debut"))
    return c.join(f, "person").groupBy("year").agg(_n().alias("n_credits"), F.countDistinct("person").alias("n_persons"), F.countDistinct("work").alias("n_works"), F.countDistinct(F.when(F.col("debut") == F.col("year"), F.col("person"))).alias("newcomers"))


@R.query(" SELECT year, coalesce(quarter, 0) AS quarter, count(*) AS n_credits, count(DISTINCT person) AS n_persons FROM crew WHERE year IS NOT NULL GROUP BY ALL")
def quarter_series(d: Domain) -> DataFrame:
    return d.crew.filter("year is not null").groupBy("year", F.coalesce("quarter", F.lit(0)).alias("quarter")).agg(_n().alias("n_credits"), F.countDistinct("person").alias("n_persons"))


@R.query(" SELECT role, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM credit), 6) AS pct FROM credit GROUP BY role ORDER BY n DESC, role LIMIT 20")
def top_roles(d: Domain) -> DataFrame:
    """Report of the 20 most frequent roles."""
    x = d.credit.groupBy("role").agg(_n().alias("n"))
    return x.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)).orderBy(F.desc("n"), "role").limit(20)


@R.query(", s AS (SELECT work, count(DISTINCT person) AS n FROM crew GROUP BY work) SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n_pairs, count(*) AS n_works, max(n) AS largest FROM s")
def pair_total(d: Domain) -> DataFrame:
    """Number of collaborating pairs over all works, from team sizes alone."""
    s = d.crew.groupBy("work").agg(F.countDistinct("person").alias("n"))
    return s.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n_pairs"), _n().alias("n_works"), F.max("n").alias("largest"))


@R.query(", s AS (SELECT work, count(DISTINCT person) AS staff, max(stage) AS top FROM crew GROUP BY work) SELECT c.person, c.work, max(least(30.0, 6.0 * stage)) + max(least(30.0, 30.0 / greatest(1.0, staff / 5.0))) AS base, max(s.staff) AS staff FROM crew c JOIN s ON s.work = c.work GROUP BY ALL")
def work_impact_base(d: Domain) -> DataFrame:
    """Role and team part of a person's impact on a work."""
    s = d.crew.groupBy("work").agg(F.countDistinct("person").alias("staff"))
    return d.crew.join(s, "work").groupBy("person", "work").agg((F.max(F.least(F.lit(30.0), 6.0 * F.col("stage"))) + F.max(F.least(F.lit(30.0), 30.0 / F.greatest(F.lit(1.0), F.col("staff") / 5.0)))).alias("base"), F.max("staff").alias("staff"))


@R.query(", s AS (SELECT work, count(DISTINCT person) AS staff, count(DISTINCT role) AS roles FROM crew GROUP BY work) SELECT w.work, round(0.4 * least(1.0, staff / 50.0) + 0.3 * least(1.0, roles / 20.0) + 0.3 * least(1.0, coalesce(w.episodes, 1) * coalesce(w.duration, 24) / 576.0), 6) AS commercial FROM work w JOIN s ON s.work = w.work")
def work_scale_value(d: Domain) -> DataFrame:
    s = d.crew.groupBy("work").agg(F.countDistinct("person").alias("staff"), F.countDistinct("role").alias("roles"))
    one = F.lit(1.0)
    return d.work.join(s, "work").select("work", F.round(0.4 * F.least(one, F.col("staff") / 50.0) + 0.3 * F.least(one, F.col("roles") / 20.0) + 0.3 * F.least(one, F.coalesce("episodes", F.lit(1)) * F.coalesce("duration", F.lit(24)) / 576.0), 6).alias("commercial"))


@R.query(", s AS (SELECT person, count(*) AS n FROM crew GROUP BY person), k AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM s) SELECT max(m) AS n_persons, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, max(CASE WHEN i = m // 4 THEN n END) AS q1, max(CASE WHEN i = m // 2 THEN n END) AS median, max(CASE WHEN i = 3 * m // 4 THEN n END) AS q3 FROM k")
def aggregate_stats(d: Domain) -> DataFrame:
    """Distribution of credits per person; quartiles by index in the order, found from counts of equal values."""
    s = d.crew.groupBy("person").agg(_n().alias("n"))
    h = s.groupBy("n").agg(_n().alias("k"))
    up = F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("n"))  # one row a distinct value
    h = h.withColumns({"hi": up, "m": F.sum("k").over(Window.partitionBy(F.lit(1)))})
    at = lambda i: F.max(F.when((i >= F.col("hi") - F.col("k")) & (i < F.col("hi")), F.col("n")))
    mean = F.sum(F.col("n") * F.col("k")) / F.sum("k")
    var = F.sum(F.col("n") * F.col("n") * F.col("k")) / F.sum("k") - mean * mean
    return h.agg(F.max("m").alias("n_persons"), F.min("n").alias("low"), F.max("n").alias("high"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"), at(F.expr("m div 4")).alias("q1"), at(F.expr("m div 2")).alias("median"), at(F.expr("3 * m div 4")).alias("q3"))


QUERIES, SQL = R.queries, R.sql
