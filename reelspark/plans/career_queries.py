"""Careers, survival, cohorts, market and inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .domain import Domain

from .registry import Registry

R = Registry()
_n = lambda: F.count("*")
#: Last year with complete records.
LAST = 2025

_YEAR = ", py AS (SELECT person, year, max(stage) AS stage, count(*) AS n, count(DISTINCT work) AS works FROM crew WHERE year IS NOT NULL GROUP BY ALL)"
_SPAN = _YEAR + ", span AS (SELECT person, min(year) AS y0, max(year) AS y1, count(*) AS active, CAST(sum(n) AS BIGINT) AS credits, max(stage) AS top FROM py GROUP BY person)"


def person_years(d: Domain) -> DataFrame:
    """(person, year, stage, n, works)."""
    return d.crew.filter("year is not null").groupBy("person", "year").agg(F.max("stage").alias("stage"), _n().alias("n"), F.countDistinct("work").alias("works"))


def spans(d: Domain) -> DataFrame:
    """(person, y0, y1, active, credits, top)."""
    return person_years(d).groupBy("person").agg(F.min("year").alias("y0"), F.max("year").alias("y1"), _n().alias("active"), F.sum("n").alias("credits"), F.max("stage").alias("top"))


_KM_SQL = """, ev AS (SELECT grp, t, count(*) AS leaving, count(*) FILTER (WHERE event) AS died FROM obs GROUP BY ALL),
risk AS (SELECT grp, t, died, sum(leaving) OVER (PARTITION BY grp ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM ev),
km AS (SELECT grp, t, died, at_risk, CASE WHEN max(CASE WHEN died >= at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN died < at_risk THEN ln(1 - died / at_risk) ELSE 0 END) OVER w) END AS s FROM risk WINDOW w AS (PARTITION BY grp ORDER BY t))
SELECT grp, t, died AS events, CAST(at_risk AS BIGINT) AS at_risk, round(s, 6) AS survival FROM km"""


def kaplan_meier(obs: DataFrame) -> DataFrame:
    """(grp, t, events, at_risk, survival) of observations (grp, t, event); windows run over distinct times of a group."""
    ev = obs.groupBy("grp", "t").agg(_n().alias("leaving"), F.count_if("event").alias("events"))
    w = Window.partitionBy("grp").orderBy("t")
    risk = ev.withColumn("at_risk", F.sum("leaving").over(w.rowsBetween(0, Window.unboundedFollowing)))
    died = F.col("events") >= F.col("at_risk")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.when(F.max(died).over(run), 0.0).otherwise(F.exp(F.sum(F.when(~died, F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(run)))
    return risk.select("grp", "t", "events", "at_risk", F.round(s, 6).alias("survival"))


@R.query(_SPAN + f", obs AS (SELECT CAST(floor(y0 / 5) * 5 AS INTEGER) AS grp, y1 - y0 AS t, y1 <= {LAST - 3} AS event FROM span)" + _KM_SQL)
def km_career(d: Domain) -> DataFrame:
    """Career survival by five-year entry cohort; active in the last three years means censored."""
    s = spans(d)
    return kaplan_meier(s.select((F.floor(F.col("y0") / 5) * 5).cast("int").alias("grp"), (F.col("y1") - F.col("y0")).alias("t"), (F.col("y1") <= LAST - 3).alias("event")))


@R.query(_YEAR + ", f AS (SELECT person, min(CASE WHEN stage >= 1 THEN year END) AS a, min(CASE WHEN stage >= 3 THEN year END) AS b, max(year) AS z FROM py GROUP BY person), obs AS (SELECT CAST(floor(a / 5) * 5 AS INTEGER) AS grp, CASE WHEN b >= a THEN b - a ELSE z - a END AS t, coalesce(b >= a, false) AS event FROM f WHERE a IS NOT NULL)" + _KM_SQL)
def km_role_tenure(d: Domain) -> DataFrame:
    """Time from the first production credit to career stage 3."""
    f = person_years(d).groupBy("person").agg(F.min(F.when(F.col("stage") >= 1, F.col("year"))).alias("a"), F.min(F.when(F.col("stage") >= 3, F.col("year"))).alias("b"), F.max("year").alias("z")).filter("a is not null")
    got = F.coalesce(F.col("b") >= F.col("a"), F.lit(False))
    return kaplan_meier(f.select((F.floor(F.col("a") / 5) * 5).cast("int").alias("grp"), F.when(got, F.col("b") - F.col("a")).otherwise(F.col("z") - F.col("a")).alias("t"), got.alias("event")))


@R.query(_SPAN + ", obs AS (SELECT coalesce(p.gender, 'unknown') AS grp, y1 - y0 AS t, top >= 4 AS event FROM span s LEFT JOIN person p ON p.person = s.person)" + _KM_SQL)
def km_stage_by_gender(d: Domain) -> DataFrame:
    s = spans(d).join(d.person.select("person", "gender"), "person", "left")
    return kaplan_meier(s.select(F.coalesce("gender", F.lit("unknown")).alias("grp"), (F.col("y1") - F.col("y0")).alias("t"), (F.col("top") >= 4).alias("event")))


@R.query(_SPAN + f", obs AS (SELECT CASE WHEN y0 < 2010 THEN 'early' ELSE 'late' END AS grp, y1 - y0 AS t, y1 <= {LAST - 3} AS event FROM span)" + """, ts AS (SELECT t, count(*) FILTER (WHERE event) AS d FROM obs GROUP BY t), g AS (SELECT DISTINCT grp FROM obs),
c AS (SELECT g.grp, ts.t, ts.d, (SELECT count(*) FROM obs o WHERE o.t >= ts.t) AS n, (SELECT count(*) FROM obs o WHERE o.t >= ts.t AND o.grp = g.grp) AS n1, (SELECT count(*) FROM obs o WHERE o.t = ts.t AND o.event AND o.grp = g.grp) AS d1 FROM ts CROSS JOIN g)
SELECT grp, CAST(sum(d1) AS BIGINT) AS observed, round(sum(d * n1 / n), 6) AS expected, round(sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) END), 6) AS variance FROM c WHERE d > 0 GROUP BY grp""")
def log_rank(d: Domain) -> DataFrame:
    """Observed and expected exits of two entry cohorts; (observed - expected)^2 / variance is chi-squared with one degree of freedom."""
    s = spans(d)
    obs = s.select(F.when(F.col("y0") < 2010, "early").otherwise("late").alias("grp"), (F.col("y1") - F.col("y0")).alias("t"), (F.col("y1") <= LAST - 3).alias("event"))
    c = obs.groupBy("t").agg(*[F.count_if(F.col("grp") == g).alias(f"l_{g}") for g in ("early", "late")], *[F.count_if(F.col("event") & (F.col("grp") == g)).alias(f"d_{g}") for g in ("early", "late")])
    w = Window.partitionBy(F.lit(1)).orderBy("t").rowsBetween(0, Window.unboundedFollowing)  # one row a distinct duration
    c = c.withColumns({f"n_{g}": F.sum(f"l_{g}").over(w) for g in ("early", "late")})
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"n_{g}").alias("n1"), F.col(f"d_{g}").alias("d1")) for g in ("early", "late")]))
    c = c.select((F.col("d_early") + F.col("d_late")).alias("d"), (F.col("n_early") + F.col("n_late")).alias("n"), each.alias("x")).select("d", "n", "x.*").filter("d > 0")
    p = F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * p * (1 - p) * (F.col("n") - F.col("d")) / (F.col("n") - 1))
    return c.groupBy("grp").agg(F.sum("d1").alias("observed"), F.round(F.sum(F.col("d") * p), 6).alias("expected"), F.round(F.sum(v), 6).alias("variance"))




@R.query(_SPAN + f", g AS (SELECT s.person, any_value(y0) AS y0, any_value(y1) AS y1, CAST(coalesce(sum(n) FILTER (WHERE p.year > {LAST - 3}), 0) AS BIGINT) AS recent, CAST(sum(n) FILTER (WHERE p.year < y0 + 3) AS BIGINT) AS early FROM span s JOIN py p ON p.person = s.person GROUP BY s.person) SELECT person, recent, early, CASE WHEN {LAST} - y0 < 2 THEN 'new' WHEN recent = 0 THEN 'inactive' WHEN recent > 1.3 * early THEN 'rising' WHEN recent < 0.5 * early THEN 'declining' ELSE 'stable' END AS trend FROM g")
def growth_trends(d: Domain) -> DataFrame:
    py = person_years(d).withColumn("y0", F.min("year").over(Window.partitionBy("person")))
    g = py.groupBy("person").agg(F.max("y0").alias("y0"), F.coalesce(F.sum(F.when(F.col("year") > LAST - 3, F.col("n"))), F.lit(0)).alias("recent"), F.sum(F.when(F.col("year") < F.col("y0") + 3, F.col("n"))).alias("early"))
    t = F.when(LAST - F.col("y0") < 2, "new").when(F.col("recent") == 0, "inactive").when(F.col("recent") > 1.3 * F.col("early"), "rising").when(F.col("recent") < 0.5 * F.col("early"), "declining").otherwise("stable")
    return g.select("person", "recent", "early", t.alias("trend"))


@R.query(_YEAR + ", m AS (SELECT person, year, stage, max(stage) OVER (PARTITION BY person ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM py) SELECT person, year, CASE WHEN before IS NULL THEN 'start' ELSE 'promotion' END AS kind, stage FROM m WHERE before IS NULL OR stage > before")
def milestones(d: Domain) -> DataFrame:
    """Career start and every year with a new highest stage."""
    before = F.max("stage").over(Window.partitionBy("person").orderBy("year").rowsBetween(Window.unboundedPreceding, -1))
    m = person_years(d).withColumn("before", before).filter("before is null or stage > before")
    return m.select("person", "year", F.when(F.col("before").isNull(), "start").otherwise("promotion").alias("kind"), "stage")


@R.query(_YEAR + ", l AS (SELECT stage AS a, lead(stage) OVER (PARTITION BY person ORDER BY year) AS b FROM py) SELECT a AS from_stage, b AS to_stage, count(*) AS n FROM l WHERE b IS NOT NULL AND a <> b GROUP BY ALL")
def role_flow(d: Domain) -> DataFrame:
    x = person_years(d).withColumn("to_stage", F.lead("stage").over(Window.partitionBy("person").orderBy("year")))
    return x.filter("to_stage is not null and stage <> to_stage").groupBy(F.col("stage").alias("from_stage"), "to_stage").agg(_n().alias("n"))


@R.query(_YEAR + ", l AS (SELECT stage AS a, lead(stage) OVER (PARTITION BY person ORDER BY year) AS b FROM py WHERE stage > 0), k AS (SELECT a, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY ALL) SELECT a AS from_stage, b AS to_stage, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM k")
def markov_transitions(d: Domain) -> DataFrame:
    x = person_years(d).filter("stage > 0").withColumn("to_stage", F.lead("stage").over(Window.partitionBy("person").orderBy("year"))).filter("to_stage is not null")
    k = x.groupBy(F.col("stage").alias("from_stage"), "to_stage").agg(_n().alias("n"))
    return k.select("from_stage", "to_stage", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_stage")), 6).alias("p"))


@R.query(_YEAR + ", f AS (SELECT person, min(year) AS y0 FROM py GROUP BY person), t AS (SELECT py.stage, py.person, min(py.year) - any_value(f.y0) AS y FROM py JOIN f ON f.person = py.person WHERE py.stage > 0 GROUP BY py.stage, py.person) SELECT stage, count(*) AS n, round(avg(y), 6) AS mean_years, round(median(y), 6) AS median_years FROM t GROUP BY stage")
def time_to_stage(d: Domain) -> DataFrame:
    py = person_years(d).withColumn("y0", F.min("year").over(Window.partitionBy("person")))
    t = py.filter("stage > 0").groupBy("stage", "person").agg((F.min("year") - F.max("y0")).alias("y"))
    return t.groupBy("stage").agg(_n().alias("n"), F.round(F.avg("y"), 6).alias("mean_years"), F.round(F.percentile("y", F.lit(0.5)), 6).alias("median_years"))


@R.query(_YEAR + ", f AS (SELECT person, min(year) AS debut FROM py GROUP BY person) SELECT py.person, py.year, py.n AS n_credits, py.works AS n_works, py.year - f.debut AS tenure FROM py JOIN f ON f.person = py.person")
def credit_panel(d: Domain) -> DataFrame:
    return person_years(d).select("person", "year", F.col("n").alias("n_credits"), F.col("works").alias("n_works"), (F.col("year") - F.min("year").over(Window.partitionBy("person"))).alias("tenure"))


@R.query(_SPAN + ", h AS (SELECT unnest([1, 3, 5, 10, 15]) AS t) SELECT CAST(floor(y0 / 10) * 10 AS INTEGER) AS cohort, CAST(h.t AS INTEGER) AS t, count(*) AS n, round(avg(CASE WHEN y1 >= y0 + h.t THEN 1.0 ELSE 0.0 END), 6) AS survival FROM span CROSS JOIN h WHERE y0 + h.t <= 2025 GROUP BY ALL")
def cohort_survival(d: Domain) -> DataFrame:
    """Share of each decade's entrants still active t years after entry, where that can be known."""
    s = spans(d).withColumn("t", F.explode(F.array(*[F.lit(t) for t in (1, 3, 5, 10, 15)]))).filter(F.col("y0") + F.col("t") <= LAST)
    return s.groupBy((F.floor(F.col("y0") / 10) * 10).cast("int").alias("cohort"), "t").agg(_n().alias("n"), F.round(F.avg(F.when(F.col("y1") >= F.col("y0") + F.col("t"), 1.0).otherwise(0.0)), 6).alias("survival"))


@R.query(_SPAN + ", y AS (SELECT y0, unnest(generate_series(greatest(y0, 1960), least(y1, 2025))) AS year FROM span) SELECT CAST(year AS INTEGER) AS year, count(*) FILTER (WHERE year - y0 < 5) AS young, count(*) FILTER (WHERE year - y0 BETWEEN 5 AND 14) AS middle, count(*) FILTER (WHERE year - y0 >= 15) AS senior FROM y GROUP BY 1")
def generation_pyramid(d: Domain) -> DataFrame:
    lo, hi = F.greatest("y0", F.lit(1960)), F.least("y1", F.lit(LAST))
    y = spans(d).filter(lo <= hi).select("y0", F.explode(F.sequence(lo, hi)).alias("year"))
    a = F.col("year") - F.col("y0")
    return y.groupBy("year").agg(F.count_if(a < 5).alias("young"), F.count_if(a.between(5, 14)).alias("middle"), F.count_if(a >= 15).alias("senior"))


@R.query(_SPAN + ", i AS (SELECT y0 AS year, count(*) AS entries FROM span GROUP BY y0), o AS (SELECT y1 AS year, count(*) AS exits FROM span WHERE y1 < 2023 GROUP BY y1) SELECT coalesce(i.year, o.year) AS year, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits, coalesce(entries, 0) - coalesce(exits, 0) AS net FROM i FULL JOIN o ON i.year = o.year")
def flow_accounting(d: Domain) -> DataFrame:
    s = spans(d)
    x = s.select(F.explode(F.array(F.struct(F.col("y0").alias("year"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("y1").alias("year"), F.lit(0).alias("i"), F.when(F.col("y1") < LAST - 2, 1).otherwise(0).alias("o")))).alias("x")).select("x.*").filter("i + o > 0")
    return x.groupBy("year").agg(F.sum("i").alias("entries"), F.sum("o").alias("exits"), (F.sum("i") - F.sum("o")).alias("net"))


_MAIN = ", sy AS (SELECT c.person, c.year, s.studio, sum(c.weight) AS w FROM crew c JOIN studio s ON s.work = c.work WHERE c.year IS NOT NULL GROUP BY ALL), assign AS (SELECT person, year, studio FROM (SELECT *, row_number() OVER (PARTITION BY person, year ORDER BY round(w, 6) DESC, studio) AS k FROM sy) WHERE k = 1)"


def assignments(d: Domain) -> DataFrame:
    """(person, year, studio): the studio with most role weight in a year; ties go to the smaller id."""
    sy = d.crew.filter("year is not null").join(d.studio, "work").groupBy("person", "year", "studio").agg(F.round(F.sum("weight"), 6).alias("w"))
    return sy.groupBy("person", "year").agg(F.min(F.struct((-F.col("w")).alias("w"), "studio")).alias("m")).select("person", "year", F.col("m.studio").alias("studio"))


@R.query(_MAIN + " SELECT person, year, studio FROM assign")
def studio_assignment(d: Domain) -> DataFrame:
    return assignments(d)


@R.query(_MAIN + ", x AS (SELECT a.person, a.year, a.studio, b.studio AS target, row_number() OVER (PARTITION BY a.person ORDER BY b.year) AS k FROM assign a JOIN assign b ON b.person = a.person AND b.year = a.year + 1 AND b.studio <> a.studio) SELECT person, year + 1 AS event_year, studio AS from_studio, target AS to_studio FROM x WHERE k = 1")
def transfer_events(d: Domain) -> DataFrame:
    """First change of studio between two consecutive years."""
    a = assignments(d)
    w = Window.partitionBy("person").orderBy("year")
    x = a.withColumns({"to_studio": F.lead("studio").over(w), "next": F.lead("year").over(w)}).filter("next = year + 1 and to_studio <> studio")
    return x.groupBy("person").agg(F.min(F.struct("next", "studio", "to_studio")).alias("m")).select("person", F.col("m.next").alias("event_year"), F.col("m.studio").alias("from_studio"), F.col("m.to_studio").alias("to_studio"))


@R.query(_MAIN + ", t AS (SELECT studio, year, count(*) AS staff FROM assign GROUP BY ALL), r AS (SELECT b.studio, b.year + 1 AS year, count(*) AS kept FROM assign a JOIN assign b ON a.person = b.person AND a.studio = b.studio AND a.year = b.year + 1 GROUP BY ALL) SELECT t.studio, t.year, t.staff, round(coalesce(kept, 0) / p.staff, 6) AS retention, round(1 - coalesce(kept, 0) / t.staff, 6) AS new_ratio FROM t LEFT JOIN r ON r.studio = t.studio AND r.year = t.year LEFT JOIN t p ON p.studio = t.studio AND p.year = t.year - 1")
def studio_timeseries(d: Domain) -> DataFrame:
    """Staff, retention of last year's staff and share of new staff by studio and year."""
    a = assignments(d)
    w = Window.partitionBy("person", "studio").orderBy("year")
    a = a.withColumn("kept", F.when(F.lag("year").over(w) == F.col("year") - 1, 1).otherwise(0))
    t = a.groupBy("studio", "year").agg(_n().alias("staff"), F.sum("kept").alias("kept"))
    v = Window.partitionBy("studio").orderBy("year")
    last = F.when(F.lag("year").over(v) == F.col("year") - 1, F.lag("staff").over(v))
    return t.select("studio", "year", "staff", F.round(F.col("kept") / last, 6).alias("retention"), F.round(1 - F.col("kept") / F.col("staff"), 6).alias("new_ratio"))


@R.query(_MAIN + ", f AS (SELECT person, min(year) AS y FROM assign GROUP BY person), d AS (SELECT a.studio, a.person, f.y FROM assign a JOIN f ON f.person = a.person AND f.y = a.year), k AS (SELECT d.studio, count(*) AS n, count(p.person) AS x FROM d LEFT JOIN (SELECT DISTINCT person, year FROM assign) p ON p.person = d.person AND p.year = d.y + 5 WHERE d.y <= 2020 GROUP BY d.studio), g AS (SELECT sum(x) / sum(n) AS p FROM k) SELECT studio, n AS debuts, x AS active_after_5, round((x / n + 1.9207294 / n - 1.96 * sqrt((x / n * (1 - x / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 4) AS low, round((x / n + 1.9207294 / n + 1.96 * sqrt((x / n * (1 - x / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 4) AS high, round((x + 10 * g.p) / (n + 10), 6) AS shrunk FROM k CROSS JOIN g")
def studio_r5_retention(d: Domain) -> DataFrame:
    """Share of a studio's debutants active five years later, with Wilson interval and shrinkage to the overall rate."""
    a = assignments(d).withColumn("y", F.min("year").over(Window.partitionBy("person")))
    later = a.filter("year = y + 5").select("person", F.lit(1).alias("back"))
    k = a.filter((F.col("year") == F.col("y")) & (F.col("y") <= LAST - 5)).join(later, "person", "left").groupBy("studio").agg(_n().alias("n"), F.count("back").alias("x"))
    g = k.agg((F.sum("x") / F.sum("n")).alias("p"))
    n, x = F.col("n"), F.col("x")
    half = 1.96 * F.sqrt((x / n * (1 - x / n) + 0.9604 / n) / n)
    mid, low = x / n + 1.9207294 / n, 1 + 3.8416 / n
    return k.crossJoin(F.broadcast(g)).select("studio", n.alias("debuts"), x.alias("active_after_5"), F.round((mid - half) / low, 4).alias("low"), F.round((mid + half) / low, 4).alias("high"), F.round((x + 10 * F.col("p")) / (n + 10), 6).alias("shrunk"))


@R.query(_MAIN + ", y AS (SELECT year, studio, count(*) AS n FROM assign GROUP BY ALL), h AS (SELECT year, count(*) AS studios, sum(power(n * 1.0 / t, 2)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY year) AS t FROM y) GROUP BY year) SELECT year, studios, round(h * 10000, 4) AS hhi, round(CASE WHEN studios = 1 THEN 1.0 ELSE (h - 1.0 / studios) / (1 - 1.0 / studios) END, 6) AS hhi_normalised FROM h")
def hhi_timeseries(d: Domain) -> DataFrame:
    y = assignments(d).groupBy("year", "studio").agg(_n().alias("n"))
    h = y.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("year"))).groupBy("year").agg(_n().alias("studios"), F.sum(F.col("p") * F.col("p")).alias("h"))
    s = F.col("studios")
    return h.select("year", "studios", F.round(F.col("h") * 10000, 4).alias("hhi"), F.round(F.when(s == 1, 1.0).otherwise((F.col("h") - 1.0 / s) / (1 - 1.0 / s)), 6).alias("hhi_normalised"))


@R.query(_MAIN + ", m AS (SELECT a.person, a.year, count(*) AS years, count(DISTINCT b.studio) AS studios FROM assign a JOIN assign b ON b.person = a.person AND b.year >= a.year AND b.year < a.year + 5 GROUP BY ALL HAVING count(*) >= 2) SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, count(*) AS n, round(avg(CASE WHEN studios > 1 THEN 1.0 ELSE 0.0 END), 6) AS mobility FROM m GROUP BY 1")
def mobility_rates(d: Domain) -> DataFrame:
    """Share of five-year windows (with two active years) spent at more than one studio."""
    w = Window.partitionBy("person").orderBy("year").rangeBetween(0, 4)
    m = assignments(d).withColumn("s", F.collect_set("studio").over(w)).withColumn("k", _n().over(w)).filter("k >= 2")
    return m.groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(_n().alias("n"), F.round(F.avg(F.when(F.size("s") > 1, 1.0).otherwise(0.0)), 6).alias("mobility"))


@R.query(_MAIN + ", l AS (SELECT studio AS a, lead(studio) OVER (PARTITION BY person ORDER BY year) AS b FROM assign) SELECT a AS from_studio, b AS to_studio, count(*) AS n FROM l WHERE b IS NOT NULL AND a <> b GROUP BY ALL")
def talent_flow(d: Domain) -> DataFrame:
    x = assignments(d).withColumn("to_studio", F.lead("studio").over(Window.partitionBy("person").orderBy("year")))
    return x.filter("to_studio is not null and to_studio <> studio").groupBy(F.col("studio").alias("from_studio"), "to_studio").agg(_n().alias("n"))


_INEQ = """, k AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) AS i, count(*) OVER (PARTITION BY grp) AS n, avg(x) OVER (PARTITION BY grp) AS m FROM v)
SELECT grp AS cohort, any_value(n) AS n, round(any_value(m), 6) AS mean, round(sum((2.0 * i - n - 1) * x) / (any_value(n) * sum(x)), 6) AS gini, round(avg((x + 1e-12) / m * ln((x + 1e-12) / m)), 6) AS theil, round(1 - power(avg(sqrt(x + 1e-12)), 2) / any_value(m), 6) AS atkinson FROM k GROUP BY grp HAVING count(*) >= 30"""


def inequality(v: DataFrame, least: int = 30) -> DataFrame:
    """Gini, Theil T and Atkinson (0.5) of (grp, x) with x > 0; ranks come from counts of equal values."""
    h = v.groupBy("grp", "x").agg(_n().alias("k"))
    w = Window.partitionBy("grp")
    h = h.withColumns({"hi": F.sum("k").over(w.orderBy("x")), "n": F.sum("k").over(w), "m": F.sum(F.col("k") * F.col("x")).over(w) / F.sum("k").over(w)})
    x, k, n, m = (F.col(c) for c in ("x", "k", "n", "m"))
    ranks = k * (2.0 * F.col("hi") - k + 1)  # sum of 2 i over the k equal values
    e = x + 1e-12
    g = h.groupBy(F.col("grp").alias("cohort")).agg(F.max("n").alias("n"), F.round(F.max("m"), 6).alias("mean"), F.round(F.sum((ranks - k * (n + 1)) * x) / (F.max("n") * F.sum(k * x)), 6).alias("gini"), F.round(F.sum(k * e / m * F.log(e / m)) / F.sum("k"), 6).alias("theil"), F.round(1 - F.pow(F.sum(k * F.sqrt(e)) / F.sum("k"), F.lit(2.0)) / F.max("m"), 6).alias("atkinson"))
    return g.filter(F.col("n") >= least)


@R.query(_SPAN + ", v AS (SELECT CAST(floor(y0 / 5) * 5 AS INTEGER) AS grp, CAST(credits AS DOUBLE) AS x FROM span)" + _INEQ)
def cohort_inequality(d: Domain) -> DataFrame:
    return inequality(spans(d).select((F.floor(F.col("y0") / 5) * 5).cast("int").alias("grp"), F.col("credits").cast("double").alias("x")))




@R.query(_SPAN + ", z AS (SELECT p.gender AS g, ln(1 + credits) AS y, CAST(y1 - y0 AS DOUBLE) AS x FROM span s JOIN person p ON p.person = s.person WHERE p.gender IN ('male', 'female')), b AS (SELECT g, avg(y) AS my, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM z GROUP BY g) SELECT m.n AS n_male, f.n AS n_female, round(m.my - f.my, 6) AS gap, round((m.mx - f.mx) * f.b, 6) AS endowment, round(f.mx * (m.b - f.b) + m.a - f.a, 6) AS structural, round((m.mx - f.mx) * (m.b - f.b), 6) AS interaction FROM b m JOIN b f ON m.g = 'male' AND f.g = 'female'")
def oaxaca_gender(d: Domain) -> DataFrame:
    """Decomposition of the gap in log credits by career length."""
    z = spans(d).join(d.person.select("person", "gender"), "person").filter(F.col("gender").isin("male", "female")).select("gender", F.log1p("credits").alias("y"), (F.col("y1") - F.col("y0")).cast("double").alias("x"))
    b = z.groupBy("gender").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), _n().alias("n"))
    one = lambda g: b.filter(F.col("gender") == g).select(*[F.col(c).alias(f"{c}_{g[0]}") for c in ("my", "mx", "b", "a", "n")])
    x = one("male").crossJoin(one("female"))  # one row each
    c = F.col
    return x.select(c("n_m").alias("n_male"), c("n_f").alias("n_female"), F.round(c("my_m") - c("my_f"), 6).alias("gap"), F.round((c("mx_m") - c("mx_f")) * c("b_f"), 6).alias("endowment"), F.round(c("mx_f") * (c("b_m") - c("b_f")) + c("a_m") - c("a_f"), 6).alias("structural"), F.round((c("mx_m") - c("mx_f")) * (c("b_m") - c("b_f")), 6).alias("interaction"))


@R.query(_YEAR + ", t AS (SELECT max(year + (coalesce(quarter, 4) - 1) * 0.25) AS last, person FROM crew WHERE year IS NOT NULL GROUP BY person) SELECT person, round(CAST(last AS DOUBLE), 6) AS last_active, round(exp(-0.5 * greatest(0.0, 2025.75 - last - 2.0)), 6) AS dormancy FROM t")
def dormancy(d: Domain) -> DataFrame:
    """Decay by quarters since the last credit, after two years of grace."""
    t = d.crew.filter("year is not null").groupBy("person").agg(F.max(F.col("year") + (F.coalesce("quarter", F.lit(4)) - 1) * 0.25).alias("last"))
    return t.select("person", F.round("last", 6).alias("last_active"), F.round(F.exp(-0.5 * F.greatest(F.lit(0.0), LAST + 0.75 - F.col("last") - 2.0)), 6).alias("dormancy"))


@R.query(_SPAN + ", d AS (SELECT c.person, any_value(s.y0) AS y0, count(*) AS n, arg_max(c.role, (c.stage, c.role)) AS role FROM crew c JOIN span s ON s.person = c.person AND c.year = s.y0 GROUP BY c.person) SELECT role AS debut_role, count(*) AS n, round(avg(CASE WHEN s.y1 >= s.y0 + 5 THEN 1.0 ELSE 0.0 END), 6) AS still_active_5 FROM d JOIN span s ON s.person = d.person WHERE s.y0 <= 2020 GROUP BY role")
def entry_roles(d: Domain) -> DataFrame:
    c = d.crew.filter("year is not null").withColumn("y0", F.min("year").over(Window.partitionBy("person")))
    deb = c.filter("year = y0").groupBy("person").agg(F.max_by("role", F.struct("stage", "role")).alias("debut_role"))
    s = spans(d).filter(F.col("y0") <= LAST - 5)
    return deb.join(s, "person").groupBy("debut_role").agg(_n().alias("n"), F.round(F.avg(F.when(F.col("y1") >= F.col("y0") + 5, 1.0).otherwise(0.0)), 6).alias("still_active_5"))


@R.query(_YEAR + ", x AS (SELECT year, avg(ln(1 + n)) AS m, count(*) AS k FROM py GROUP BY year), g AS (SELECT avg(ln(1 + n)) AS g FROM py) SELECT year, k AS n, round(m - g, 6) AS era_effect FROM x CROSS JOIN g")
def era_effects(d: Domain) -> DataFrame:
    h = person_years(d).groupBy("year").agg(F.sum(F.log1p("n")).alias("s"), _n().alias("n"))
    g = h.agg((F.sum("s") / F.sum("n")).alias("g"))
    return h.crossJoin(F.broadcast(g)).select("year", "n", F.round(F.col("s") / F.col("n") - F.col("g"), 6).alias("era_effect"))


_EVENT = _MAIN + ", tr AS (SELECT person, min(e) AS e FROM (SELECT a.person, b.year AS e FROM assign a JOIN assign b ON b.person = a.person AND b.year = a.year + 1 AND b.studio <> a.studio) GROUP BY person)" + _YEAR


@R.query(_EVENT + " SELECT py.year - tr.e AS k, count(*) AS n, round(avg(py.works), 6) AS mean_works FROM py JOIN tr ON tr.person = py.person WHERE py.year - tr.e BETWEEN -3 AND 5 GROUP BY 1")
def event_study(d: Domain) -> DataFrame:
    """Mean works by years since the first change of studio."""
    tr = transfer_events(d).select("person", "event_year")
    k = F.col("year") - F.col("event_year")
    return person_years(d).join(tr, "person").filter(k.between(-3, 5)).groupBy(k.alias("k")).agg(_n().alias("n"), F.round(F.avg("works"), 6).alias("mean_works"))


@R.query(_EVENT + ", g AS (SELECT CAST(median(e) AS INTEGER) AS m FROM tr), z AS (SELECT tr.person IS NOT NULL AS treated, py.year >= coalesce(tr.e, g.m) AS post, py.works FROM py CROSS JOIN g LEFT JOIN tr ON tr.person = py.person) SELECT round((avg(works) FILTER (WHERE treated AND post) - avg(works) FILTER (WHERE treated AND NOT post)) - (avg(works) FILTER (WHERE NOT treated AND post) - avg(works) FILTER (WHERE NOT treated AND NOT post)), 6) AS did, count(*) FILTER (WHERE treated) AS n_treated, count(*) FILTER (WHERE NOT treated) AS n_control FROM z")
def did_transfer(d: Domain) -> DataFrame:
    """Difference in differences of works: persons who changed studio against all others."""
    tr = transfer_events(d).select("person", "event_year")
    m = tr.agg(F.bround(F.percentile("event_year", F.lit(0.5))).cast("int").alias("m"))
    z = person_years(d).join(tr, "person", "left").crossJoin(F.broadcast(m))
    treated, post = F.col("event_year").isNotNull(), F.col("year") >= F.coalesce("event_year", "m")
    mean = lambda c: F.avg(F.when(c, F.col("works")))
    return z.agg(F.round(mean(treated & post) - mean(treated & ~post) - (mean(~treated & post) - mean(~treated & ~post)), 6).alias("did"), F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control"))


QUERIES, SQL = R.queries, R.sql
