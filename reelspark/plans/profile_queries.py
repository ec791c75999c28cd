"""Profiles of persons and works, voice-actor graphs, name and duplicate checks, cores and paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import DIRECTORS, in_list
from ..functions.textual import LONGEST_CUT, alike_keys, indel
from ..operators import blocks
from ..operators import graphs as gr
from ..operators import iterative as it
from ..session import Shelf
from .career_queries import _MAIN, _YEAR, assignments, person_years
from .domain import Domain
from .network_queries import _TEAM, _TIES, graph, mentorships, team, ties
from .quality_queries import _NAME, _name
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")
#: Year that ages are counted to.
NOW = 2026

_STAFF = ", staff AS (SELECT work, count(DISTINCT person) AS staff, count(DISTINCT role) AS roles FROM credit GROUP BY work)"


def staffing(d: Domain) -> DataFrame:
    """(work, staff, roles): distinct persons and roles."""
    return d.credit.groupBy("work").agg(F.countDistinct("person").alias("staff"), F.countDistinct("role").alias("roles"))


@R.query(_STAFF + ", x AS (SELECT DISTINCT person, work FROM credit) SELECT x.person, count(*) AS works, round(avg(s.staff), 6) AS mean_staff, min(w.year) AS first_year, max(w.year) AS last_year FROM x JOIN staff s ON s.work = x.work JOIN work w ON w.work = x.work GROUP BY x.person")
def person_work_stats(d: Domain) -> DataFrame:
    """Works, mean size of their staff and span of years of each person."""
    x = d.credit.select("person", "work").distinct().join(staffing(d), "work").join(d.work.select("work", "year"), "work")
    return x.groupBy("person").agg(_n().alias("works"), F.round(F.avg("staff"), 6).alias("mean_staff"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@R.query(_STAFF + ", x AS (SELECT DISTINCT person, work FROM credit), t AS (SELECT x.person, coalesce(w.title, w.work) AS title, max(s.staff) AS staff FROM x JOIN staff s ON s.work = x.work JOIN work w ON w.work = x.work GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY staff DESC, title) AS place FROM t) SELECT person, place, title, staff FROM k WHERE place <= 5")
def person_top_works(d: Domain) -> DataFrame:
    """The five titles with most staff of each person; rows of one title count once."""
    x = d.credit.select("person", "work").distinct().join(staffing(d), "work").join(d.work.select("work", F.coalesce("title", "work").alias("title")), "work")
    t = x.groupBy("person", "title").agg(F.max("staff").alias("staff"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("staff"), "title"))).filter("place <= 5").select("person", "place", "title", "staff")


@R.query(_STAFF + f" SELECT w.work, round(0.4 * least(1.0, coalesce(s.staff, 0) / 50.0) + 0.3 * least(1.0, coalesce(s.roles, 0) / 20.0) + 0.3 * least(1.0, coalesce(episodes, 1) * coalesce(duration, 24) / 576.0), 6) AS commercial, round(CASE WHEN year IS NULL THEN 0.5 ELSE 0.5 * least(1.0, ({NOW} - year) / 20.0) + 0.5 * CASE WHEN {NOW} - year > 10 THEN 0.8 WHEN {NOW} - year > 5 THEN 0.6 ELSE 0.4 END END, 6) AS cultural FROM work w LEFT JOIN staff s ON s.work = w.work")
def work_values(d: Domain) -> DataFrame:
    """Commercial value by staff, roles and length; cultural value by age."""
    x = d.work.join(staffing(d), "work", "left")
    part = lambda c, most: F.least(F.lit(1.0), c / F.lit(most))
    age = F.lit(NOW) - F.col("year")
    commercial = 0.4 * part(F.coalesce("staff", F.lit(0)), 50.0) + 0.3 * part(F.coalesce("roles", F.lit(0)), 20.0) + 0.3 * part(F.coalesce("episodes", F.lit(1)) * F.coalesce("duration", F.lit(24)), 576.0)
    cultural = F.when(F.col("year").isNull(), 0.5).otherwise(0.5 * part(age, 20.0) + 0.5 * F.when(age > 10, 0.8).when(age > 5, 0.6).otherwise(0.4))
    return x.select("work", F.round(commercial, 6).alias("commercial"), F.round(cultural, 6).alias("cultural"))


# Works looked back on, and the part of the usual rate below which a pair counts as decayed.
WINDOW, DECAYED = 5, 0.5


@R.query(f", dr AS (SELECT c.person AS director, k.year, c.work FROM credit c JOIN work k ON k.work = c.work WHERE c.role IN {in_list(DIRECTORS)} AND k.year IS NOT NULL), dt AS (SELECT director, count(*) AS total FROM dr GROUP BY director HAVING count(*) >= {WINDOW}), rw AS (SELECT *, row_number() OVER (PARTITION BY director ORDER BY year DESC, work DESC) AS k FROM dr), pw AS (SELECT DISTINCT person, work FROM credit WHERE person NOT IN (SELECT person FROM credit WHERE role IN {in_list(DIRECTORS)})), dw AS (SELECT director, work, count(*) FILTER (WHERE k <= {WINDOW}) AS recent FROM rw GROUP BY ALL), s AS (SELECT pw.person, dw.director, count(*) AS appearances, sum(recent) AS recent FROM pw JOIN dw ON dw.work = pw.work GROUP BY ALL) SELECT s.person, s.director, round(appearances / total, 3) AS expected_rate, round(recent / {WINDOW}, 3) AS recent_rate, total AS total_works, appearances, CAST(recent AS BIGINT) AS recent_works FROM s JOIN dt ON dt.director = s.director WHERE recent / {WINDOW} < appearances / total * {DECAYED}")
def engagement_decay(d: Domain) -> DataFrame:
    """Pairs of a director and a person who never directs, met in the director's last five rows less than half as often as before."""
    lead = d.credit.filter(F.col("role").isin(*DIRECTORS))
    dr = lead.select(F.col("person").alias("director"), "work").join(d.work.filter("year is not null").select("work", "year"), "work")
    dt = dr.groupBy("director").agg(_n().alias("total")).filter(F.col("total") >= WINDOW)
    k = F.row_number().over(Window.partitionBy("director").orderBy(F.desc("year"), F.desc("work")))
    dw = dr.withColumn("k", k).groupBy("director", "work").agg(F.count_if(F.col("k") <= WINDOW).alias("recent"))
    pw = d.credit.select("person", "work").distinct().join(lead.select("person").distinct(), "person", "left_anti")
    s = pw.join(dw, "work").groupBy("person", "director").agg(_n().alias("appearances"), F.sum("recent").alias("recent_works")).join(dt, "director")
    now, usual = F.col("recent_works") / WINDOW, F.col("appearances") / F.col("total")
    return s.filter(now < usual * DECAYED).select("person", "director", F.round(usual, 3).alias("expected_rate"), F.round(now, 3).alias("recent_rate"), F.col("total").alias("total_works"), "appearances", "recent_works")


_MENTORS = ", mm AS (SELECT work, person, max(stage) AS stage, count(*) AS n FROM crew GROUP BY ALL), ment AS (SELECT a.person AS mentor, b.person AS mentee FROM mm a JOIN mm b ON a.work = b.work AND a.stage - b.stage >= 2 GROUP BY ALL HAVING count(*) >= 3)"


@R.query(_MENTORS + " SELECT mentor AS person, count(*) AS mentees, string_agg(mentee, ',' ORDER BY mentee) AS children, mentor NOT IN (SELECT mentee FROM ment) AS is_root FROM ment GROUP BY mentor")
def mentorship_tree(d: Domain) -> DataFrame:
    """Mentees of each mentor in order, and whether the mentor has none above."""
    m = Shelf(d.spark, "mentors").put(mentorships(d).select("mentor", "mentee"), "pairs")
    tree = m.groupBy(F.col("mentor").alias("person")).agg(_n().alias("mentees"), F.array_join(F.array_sort(F.collect_list("mentee")), ",").alias("children"))
    return tree.join(m.select(F.col("mentee").alias("person"), F.lit(False).alias("root")).distinct(), "person", "left").select("person", "mentees", "children", F.coalesce("root", F.lit(True)).alias("is_root"))


@R.query(_YEAR + ", db AS (SELECT person, min(year) AS y0, max(year) AS y1, sum(n) AS credits, max(stage) AS top FROM py GROUP BY person) SELECT CAST(y0 // 10 * 10 AS INTEGER) AS decade, count(*) AS persons, round(avg(credits), 6) AS mean_credits, CAST(list_sort(list(credits))[len(list(credits)) // 2 + 1] AS BIGINT) AS upper_median, round(avg(y1 - y0 + 1), 6) AS mean_years, round(avg(top), 6) AS mean_stage FROM db GROUP BY 1")
def debut_cohorts(d: Domain) -> DataFrame:
    """Persons by decade of debut; the median is the upper one, found by rank instead of a list of the cohort."""
    p = person_years(d).groupBy("person").agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.sum("n").alias("credits"), F.max("stage").alias("top")).withColumn("decade", (F.floor(F.col("y0") / 10) * 10).cast("int"))
    g = p.groupBy("decade").agg(_n().alias("persons"), F.round(F.avg("credits"), 6).alias("mean_credits"), F.round(F.avg(F.col("y1") - F.col("y0") + 1), 6).alias("mean_years"), F.round(F.avg("top"), 6).alias("mean_stage"))
    h = p.groupBy("decade", "credits").agg(_n().alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy("decade").orderBy("credits")))
    mid = h.join(g.select("decade", "persons"), "decade").filter("upto > persons div 2").groupBy("decade").agg(F.min("credits").alias("upper_median"))
    return g.join(mid, "decade").select("decade", "persons", "mean_credits", "upper_median", "mean_years", "mean_stage")


@R.query(_YEAR + ", yc AS (SELECT person, year, n, lag(n) OVER (PARTITION BY person ORDER BY year) AS before FROM py) SELECT person, year, n AS credits, round(n / before - 1, 6) AS change, CASE WHEN n > before THEN 'surge' ELSE 'drop' END AS kind FROM yc WHERE before IS NOT NULL AND (n / before - 1 > 1 OR n / before - 1 < -0.5)")
def turning_points(d: Domain) -> DataFrame:
    """Active years with more than twice or less than half the credits of the one before."""
    change = F.col("credits") / F.col("before") - 1
    x = person_years(d).select("person", "year", F.col("n").alias("credits"), F.lag("n").over(Window.partitionBy("person").orderBy("year")).alias("before")).filter("before is not null")
    return x.filter((change > 1) | (change < -0.5)).select("person", "year", "credits", F.round(change, 6).alias("change"), F.when(F.col("credits") > F.col("before"), "surge").otherwise("drop").alias("kind"))


@R.query(_YEAR + ", g AS (SELECT year, count(*) AS persons, CAST(sum(n) AS BIGINT) AS credits FROM py GROUP BY year) SELECT year, persons, credits, persons - lag(persons) OVER (ORDER BY year) AS persons_change, credits - lag(credits) OVER (ORDER BY year) AS credits_change FROM g")
def industry_trends(d: Domain) -> DataFrame:
    """Active persons and credits a year and their change."""
    g = person_years(d).groupBy("year").agg(_n().alias("persons"), F.sum("n").alias("credits"))
    w = Window.partitionBy(F.lit(1)).orderBy("year")  # one row a year
    return g.withColumns({"persons_change": F.col("persons") - F.lag("persons").over(w), "credits_change": F.col("credits") - F.lag("credits").over(w)})


@R.query(_MAIN + ", m AS (SELECT person, year, studio, lead(studio) OVER (PARTITION BY person ORDER BY year) AS nxt, lead(year) OVER (PARTITION BY person ORDER BY year) AS ny FROM assign) SELECT studio AS from_studio, nxt AS to_studio, count(*) AS n_moves, count(DISTINCT person) AS persons, round(avg(ny - year), 6) AS mean_gap FROM m WHERE nxt <> studio GROUP BY ALL")
def studio_transitions(d: Domain) -> DataFrame:
    """Moves between studios of successive active years."""
    w = Window.partitionBy("person").orderBy("year")
    m = assignments(d).withColumns({"nxt": F.lead("studio").over(w), "ny": F.lead("year").over(w)}).filter("nxt <> studio")
    return m.groupBy(F.col("studio").alias("from_studio"), F.col("nxt").alias("to_studio")).agg(_n().alias("n_moves"), F.countDistinct("person").alias("persons"), F.round(F.avg(F.col("ny") - F.col("year")), 6).alias("mean_gap"))


# Weights of casting, bonus of returning characters, bonus of two leads.
CAST_WEIGHTS = {"MAIN": 3.0, "SUPPORTING": 1.5, "BACKGROUND": 0.5}
CAST_OTHER, RETURN_STEP, RETURN_MOST, CO_MAIN = 0.5, 0.1, 1.5, 1.5
_CW = "CASE v.role WHEN 'MAIN' THEN 3.0 WHEN 'SUPPORTING' THEN 1.5 ELSE 0.5 END"
_LONG = "coalesce(least(k.duration / 30.0, 2.0), 1.0)"


def _cast_weight():  # noqa: ANN202
    w = F.lit(CAST_OTHER)
    for role, v in CAST_WEIGHTS.items():
        w = F.when(F.col("role") == role, v).otherwise(w)
    return w


def _cast(d: Domain) -> DataFrame:
    """(work, person, w, long): best casting of a person on a work and the work's length factor."""
    best = d.cast.groupBy("work", "person").agg(F.max(_cast_weight()).alias("w"))
    return best.join(d.work.select("work", F.least(F.col("duration") / 30.0, F.lit(2.0)).alias("long")), "work", "left").withColumn("long", F.coalesce("long", F.lit(1.0)))


@R.query(f", fb AS (SELECT person, \"character\", least(1.0 + 0.1 * (count(DISTINCT work) - 1), 1.5) AS bonus FROM voice GROUP BY ALL) SELECT v.person, v.work, round(sum({_CW} * bonus * {_LONG}), 6) AS weight FROM voice v JOIN fb ON fb.person = v.person AND fb.\"character\" = v.\"character\" LEFT JOIN work k ON k.work = v.work GROUP BY ALL")
def va_work_edges(d: Domain) -> DataFrame:
    """Voice actor and work: casting weight, more for characters that return, by length."""
    fb = d.cast.groupBy("person", "character").agg(F.least(1.0 + RETURN_STEP * (F.countDistinct("work") - 1), F.lit(RETURN_MOST)).alias("bonus"))
    x = d.cast.join(fb, ["person", "character"]).join(d.work.select("work", F.least(F.col("duration") / 30.0, F.lit(2.0)).alias("long")), "work", "left")
    return x.groupBy("person", "work").agg(F.round(F.sum(_cast_weight() * F.col("bonus") * F.coalesce("long", F.lit(1.0))), 6).alias("weight"))


@R.query(f", b AS (SELECT v.work, v.person, max({_CW}) AS w, any_value({_LONG}) AS long FROM voice v LEFT JOIN work k ON k.work = v.work GROUP BY ALL), h AS (SELECT work, max(w) >= 3 AS lead FROM b GROUP BY work) SELECT x.person AS va_a, y.person AS va_b, round(sum(least(x.w, y.w) * x.long * CASE WHEN x.w >= 3 AND y.w >= 3 THEN 1.5 ELSE 1.0 END), 6) AS weight FROM b x JOIN b y ON x.work = y.work AND x.person < y.person JOIN h ON h.work = x.work WHERE NOT h.lead OR x.w >= 3 OR y.w >= 3 GROUP BY ALL")
def va_collaboration_edges(d: Domain) -> DataFrame:
    """Voice actors of one cast: leads meet all, the rest meets only leads; without a lead all meet."""
    t = _cast(d)
    t = t.join(t.groupBy("work").agg((F.max("w") >= 3).alias("led")), "work").withColumn("hub", (F.col("w") >= 3) | ~F.col("led"))
    lead = t.filter("hub").select("work", F.col("person").alias("p"), F.col("w").alias("wp"), "long")
    rest = t.select("work", F.col("person").alias("q"), F.col("w").alias("wq"), "hub")
    x = lead.join(rest, "work").filter((F.col("p") != F.col("q")) & (~F.col("hub") | (F.col("p") < F.col("q"))))
    part = F.least("wp", "wq") * F.col("long") * F.when((F.col("wp") >= 3) & (F.col("wq") >= 3), CO_MAIN).otherwise(1.0)
    return x.groupBy(F.least("p", "q").alias("va_a"), F.greatest("p", "q").alias("va_b")).agg(F.round(F.sum(part), 6).alias("weight"))


@R.query(f", b AS (SELECT v.work, v.person, max({_CW}) AS w, any_value({_LONG}) AS long FROM voice v LEFT JOIN work k ON k.work = v.work GROUP BY ALL), sd AS (SELECT DISTINCT work, person AS director FROM credit WHERE role = 'sound_director') SELECT b.person, sd.director, count(*) AS works, round(sum(w * long), 6) AS weight FROM b JOIN sd ON sd.work = b.work GROUP BY ALL")
def va_director_edges(d: Domain) -> DataFrame:
    """Voice actors and the sound directors of their works."""
    sd = d.credit.filter("role = 'sound_director'").select("work", F.col("person").alias("director")).distinct()
    return _cast(d).join(sd, "work").groupBy("person", "director").agg(_n().alias("works"), F.round(F.sum(F.col("w") * F.col("long")), 6).alias("weight"))


@R.query()
def va_effects(d: Domain) -> DataFrame:
    """Voice actors' effects beside those of sound directors: the best casting's outcome on a work, unweighted; persons alone where fewer than 5 % move."""
    shelf = Shelf(d.spark, "va")
    size = d.cast.groupBy("work").agg(F.countDistinct("person").alias("size"))
    w = d.work.select("work", F.coalesce("episodes", F.lit(1)).alias("eps"), F.least(F.coalesce("duration", F.lit(24)) / 30.0, F.lit(2.0)).alias("long"))
    y = F.col("w") * F.log1p("size") * F.log1p("eps") * F.col("long")
    x = _cast(d).drop("long").join(size, "work").join(w, "work").select("person", "work", y.alias("y"))
    # of several sound directors of a work the one with most works of the voice actor, then the smaller id
    sd = d.credit.filter("role = 'sound_director'").select("work", F.col("person").alias("studio")).distinct()
    x = x.join(sd, "work")
    often = x.groupBy("person", "studio").agg(_n().alias("k"))
    x = x.join(often, ["person", "studio"]).groupBy("person", "work", "y").agg(F.min(F.struct((-F.col("k")).alias("k"), "studio")).alias("m")).select("person", F.col("m.studio").alias("studio"), "y", F.lit(1.0).alias("w"))
    x = shelf.put(x, "panel")
    move = x.groupBy("person").agg((F.countDistinct("studio") > 1).cast("int").alias("moves")).agg(F.avg("moves")).first()[0] or 0.0
    p, s = it.two_way_effects(x, shelf) if move >= 0.05 else (x.groupBy("person").agg(F.avg("y").alias("effect")), x.groupBy("studio").agg(F.lit(0.0).alias("effect")))
    out = it.shrink_effects(x, shelf.put(p, "p"), shelf.put(s, "s"))
    return out.select("person", F.round("effect", 6).alias("effect"), F.round("shrunk", 6).alias("shrunk"), "n")


@R.query(" SELECT year, quarter, count(*) AS n, year + (quarter - 1) * 0.25 AS at, year || '-Q' || quarter AS label, CAST(year * 4 + quarter - min(year * 4 + quarter) OVER () AS BIGINT) AS since FROM crew WHERE year IS NOT NULL AND quarter IS NOT NULL GROUP BY year, quarter")
def credit_quarters(d: Domain) -> DataFrame:
    """Credits a quarter: as a fraction of years, as a label and in quarters since the first."""
    g = d.crew.filter("year is not null and quarter is not null").groupBy("year", "quarter").agg(_n().alias("n"))
    at = F.col("year") * 4 + F.col("quarter")
    first = F.min(at).over(Window.partitionBy(F.lit(1)))  # one row a quarter
    return g.select("year", "quarter", "n", (F.col("year") + (F.col("quarter") - 1) * 0.25).alias("at"), F.format_string("%d-Q%d", "year", "quarter").alias("label"), (at - first).cast("bigint").alias("since"))


# Letters that tell a name's script, asked in this order.
SCRIPTS = (("ko", "[\\uAC00-\\uD7AF\\u1100-\\u11FF]"), ("ja", "[\\u3040-\\u30FF]"), ("zh_or_ja", "[\\u4E00-\\u9FFF]"), ("en", "[A-Za-z]"))


def _script_sql(c: str) -> str:
    return "CASE WHEN coalesce(trim(" + c + "), '') = '' THEN 'none' " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{k}'" for k, p in SCRIPTS) + " ELSE 'other' END"


@R.query(f" SELECT {_script_sql('name_ja')} AS script, count(*) AS n FROM person GROUP BY 1".replace("[\\uAC00-\\uD7AF\\u1100-\\u11FF]", "[가-힯ᄀ-ᇿ]").replace("[\\u3040-\\u30FF]", "[぀-ヿ]").replace("[\\u4E00-\\u9FFF]", "[一-鿿]"))
def name_scripts(d: Domain) -> DataFrame:
    """Persons by the script of the native name: Hangul, kana, Han alone, Latin."""
    c = F.col("name_ja")
    script = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "none")
    for k, p in SCRIPTS:
        script = script.when(c.rlike(p), k)
    return d.person.groupBy(script.otherwise("other").alias("script")).agg(_n().alias("n"))


#: Names shorter than this link nothing.
LEAST_NAME = 5
_ROMAJI = "array_to_string(list_sort(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({}, '[''’-]', '', 'g'), '[^A-Za-z]+', ' ', 'g')), ' +'), lambda t: t <> '')), ' ')"
_ROMAJI_SQL = f", rn AS (SELECT person, split_part(person, ':', 1) AS src, {_ROMAJI.format('name_en')} AS k FROM person WHERE length(name_en) >= {LEAST_NAME}), rm AS (SELECT k, min(person) AS canonical FROM rn WHERE src = 'mal' AND k <> '' GROUP BY k HAVING count(*) = 1)"


def romaji_key(c: str):  # noqa: ANN201
    """Letters of a Latin name in lower case, its parts in order of the alphabet."""
    parts = F.split(F.lower(F.regexp_replace(F.regexp_replace(c, "['’-]", ""), "[^A-Za-z]+", " ")), " +")
    return F.array_join(F.array_sort(F.filter(parts, lambda t: t != "")), " ")


@R.query(_ROMAJI_SQL + " SELECT rn.person, rm.canonical, rn.k AS name FROM rn JOIN rm ON rm.k = rn.k WHERE rn.src = 'anilist'")
def romaji_matches(d: Domain) -> DataFrame:
    """Persons of one source whose Latin name, whatever the order of its parts, belongs to just one person of the other."""
    rn = d.person.filter(F.length("name_en") >= LEAST_NAME).select("person", F.split_part("person", F.lit(":"), F.lit(1)).alias("src"), romaji_key("name_en").alias("k")).filter("k <> ''")
    rm = rn.filter("src = 'mal'").groupBy("k").agg(F.min("person").alias("canonical"), _n().alias("n")).filter("n = 1")
    return rn.filter("src = 'anilist'").join(rm, "k").select("person", "canonical", F.col("k").alias("name"))


_LIKE = f", nf AS (SELECT DISTINCT person, {_NAME.format('name')} AS name FROM (SELECT person, name_ja AS name FROM person UNION ALL SELECT person, name_en FROM person) WHERE coalesce(name, '') <> ''), nu AS (SELECT split_part(person, ':', 1) AS src, name, min(person) AS person, substr(name, 1, 3) AS k FROM nf WHERE length(name) >= {LEAST_NAME} GROUP BY 1, 2 HAVING count(*) = 1), lk AS (SELECT a.person AS pa, b.person AS pb, length(a.name) + length(b.name) AS l, abs(length(a.name) - length(b.name)) AS dl, levenshtein(a.name, b.name) AS e FROM nu a JOIN nu b ON a.src = b.src AND a.k = b.k AND a.name < b.name AND a.person <> b.person)"


def alike_names(d: Domain) -> DataFrame:
    """(person_a, person_b): one-to-one names of a source with an indel ratio of 0.95.

    Names share their first three letters and one whole part; lengths and edits bound the ratio, so it is computed for few.
    """
    names = d.person.select("person", F.explode(F.array("name_ja", "name_en")).alias("name")).filter("name <> ''").select("person", _name("name").alias("name")).distinct().filter(F.length("name") >= LEAST_NAME)
    one = names.groupBy(F.split_part("person", F.lit(":"), F.lit(1)).alias("src"), "name").agg(F.min("person").alias("person"), _n().alias("n")).filter("n = 1").withColumn("k", F.substring("name", 1, 3))
    met = _met(one.filter(F.length("name") <= LONGEST_CUT))
    # longer names meet all of their head; of a ratio of 0.95, the shorter one has 0.9 of their length or more
    a, b = (one.filter(F.length("name") >= 0.9 * LONGEST_CUT).select("src", "k", F.col("name").alias(f"name_{x}"), F.col("person").alias(f"p_{x}")) for x in "ab")
    met = met.unionByName(a.join(b, ["src", "k"]).filter(F.length("name_a") > LONGEST_CUT).drop("src", "k"))
    most = "CAST(floor(0.05D * (length(name_a) + length(name_b)) + 1e-9D) AS INT)"
    x = met.filter((F.col("name_a") != F.col("name_b")) & (F.col("p_a") != F.col("p_b")) & F.expr(f"abs(length(name_a) - length(name_b)) <= {most}"))
    x = x.filter(F.expr(f"levenshtein(name_a, name_b, {most}) >= 0")).distinct().filter(indel(F.col("name_a"), F.col("name_b")) >= 0.95)
    return x.select(F.least("p_a", "p_b").alias("person_a"), F.greatest("p_a", "p_b").alias("person_b")).distinct()


def _met(one: DataFrame) -> DataFrame:
    """(name_a, p_a, name_b, p_b) of (src, k, name, person) that share a key of ``alike_keys``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keys = [alike_keys(t, 3) for t in x["name"]]
            yield x.assign(own=[k[0] for k in keys], other=[k[1] for k in keys])

    keyed = one.filter(F.length("name") >= 10).select("src", "k", "name", "person").mapInPandas(run, "src string, k string, name string, person string, own array<long>, other array<long>")
    a, b = (keyed.select("src", "k", F.explode(c).alias("key"), F.col("name").alias(f"name_{x}"), F.col("person").alias(f"p_{x}")) for x, c in (("a", "own"), ("b", "other")))
    return a.join(b, ["src", "k", "key"]).drop("src", "k", "key")


# by edits, for names of up to 80 letters together
_ALIKE = "((dl = 1 AND e = 1 AND l >= 20) OR (l >= 40 AND dl IN (0, 2) AND e = (CASE WHEN dl = 0 THEN 1 ELSE 2 END)))"


@R.query(_LIKE + f" SELECT DISTINCT least(pa, pb) AS person_a, greatest(pa, pb) AS person_b FROM lk WHERE {_ALIKE}")
def similar_persons(d: Domain) -> DataFrame:
    """Persons of one source whose names are alike."""
    return alike_names(d)


@R.query(f", v AS (SELECT lower(trim(canonical_id)) AS id, {_NAME.format('title_ja')} AS title, year, lower(trim(format)) AS format FROM anime WHERE year BETWEEN 1900 AND 2100) SELECT title, year, format, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM v WHERE title <> '' AND format IS NOT NULL GROUP BY title, year, format HAVING count(DISTINCT split_part(id, ':', 1)) > 1")
def duplicate_works(d: Domain) -> DataFrame:
    """Works of several sources with one title, year and format."""
    v = d.raw("anime").filter(F.col("year").between(1900, 2100)).select(F.lower(F.trim("canonical_id")).alias("id"), _name("title_ja").alias("title"), "year", F.lower(F.trim("format")).alias("format")).filter("title <> '' and format is not null")
    return v.groupBy("title", "year", "format").agg(_n().alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.countDistinct(F.split_part("id", F.lit(":"), F.lit(1))).alias("s")).filter("s > 1").drop("s")


_CHARS = f", ch AS (SELECT lower(trim(id)) AS id, split_part(lower(trim(id)), ':', 1) AS src, CASE WHEN coalesce(trim(name_ja), '') <> '' THEN {_NAME.format('name_ja')} ELSE {_NAME.format('name_en')} END AS name FROM characters)"


def _same_name(d: Domain) -> DataFrame:
    """(id, src, name) of characters with a name."""
    name = F.when(F.trim(F.coalesce("name_ja", F.lit(""))) != "", _name("name_ja")).otherwise(_name("name_en"))
    return d.raw("characters").select(F.lower(F.trim("id")).alias("id"), name.alias("name")).filter("name <> ''").withColumn("src", F.split_part("id", F.lit(":"), F.lit(1)))


def _shared(d: Domain, by: str) -> DataFrame:
    """Pairs of one name in different sources that share a column of the cast; the name is part of the join key."""
    c = _same_name(d).join(d.cast.select(F.col("character").alias("id"), by).distinct(), "id")
    a, b = (c.select("name", by, F.col("id").alias(f"id_{x}"), F.col("src").alias(f"src_{x}")) for x in "ab")
    return a.join(b, ["name", by]).filter("id_a < id_b and src_a <> src_b").select("id_a", "id_b", "name").distinct()


@R.query(_CHARS + " SELECT DISTINCT a.id AS id_a, b.id AS id_b, a.name FROM ch a JOIN ch b ON a.name = b.name AND a.id < b.id AND a.src <> b.src AND a.name <> '' JOIN voice x ON x.\"character\" = a.id JOIN voice y ON y.\"character\" = b.id AND y.person = x.person")
def duplicate_characters_by_voice(d: Domain) -> DataFrame:
    """Characters of two sources with one name and a voice actor in common."""
    return _shared(d, "person")


@R.query(_CHARS + " SELECT DISTINCT a.id AS id_a, b.id AS id_b, a.name FROM ch a JOIN ch b ON a.name = b.name AND a.id < b.id AND a.src <> b.src AND a.name <> '' JOIN voice x ON x.\"character\" = a.id JOIN voice y ON y.\"character\" = b.id AND y.work = x.work")
def duplicate_characters_by_work(d: Domain) -> DataFrame:
    """Characters of two sources with one name and a work in common."""
    return _shared(d, "work")


@R.query(" SELECT anilist_id, count(*) AS n, min(id) AS id_a, max(id) AS id_b FROM (SELECT DISTINCT anilist_id, lower(trim(id)) AS id FROM characters WHERE anilist_id IS NOT NULL) GROUP BY anilist_id HAVING count(*) > 1")
def duplicate_characters_by_number(d: Domain) -> DataFrame:
    """Characters under one outer number."""
    x = d.raw("characters").filter("anilist_id is not null").select("anilist_id", F.lower(F.trim("id")).alias("id")).distinct()
    return x.groupBy("anilist_id").agg(_n().alias("n"), F.min("id").alias("id_a"), F.max("id").alias("id_b")).filter("n > 1")


@R.query(" SELECT split_part(lower(trim(canonical_id)), ':', 1) AS source, count(*) AS works, count(*) FILTER (WHERE year BETWEEN 1900 AND 2100) AS with_year, count(title_ja) AS with_title FROM anime GROUP BY 1")
def source_prefixes(d: Domain) -> DataFrame:
    """Works by the source their id names."""
    return d.raw("anime").groupBy(F.split_part(F.lower(F.trim("canonical_id")), F.lit(":"), F.lit(1)).alias("source")).agg(_n().alias("works"), F.count_if(F.col("year").between(1900, 2100)).alias("with_year"), F.count("title_ja").alias("with_title"))


@R.query(_TIES + ", g AS (SELECT nb.u, a.gender AS ga, b.gender AS gb FROM nb JOIN person a ON a.person = nb.u JOIN person b ON b.person = nb.v WHERE a.gender IN ('male', 'female') AND b.gender IN ('male', 'female')) SELECT u AS person, any_value(ga) AS gender, count(*) AS partners, round(count(*) FILTER (WHERE ga = gb) / count(*), 6) AS same_share FROM g GROUP BY u")
def ego_gender(d: Domain) -> DataFrame:
    """Share of a person's partners of the same gender, where both are known."""
    g = d.person.filter(F.col("gender").isin("male", "female")).select("person", "gender")
    x = gr.both_directions(ties(d)).join(g.toDF("u", "ga"), "u").join(g.toDF("v", "gb"), "v")
    return x.groupBy(F.col("u").alias("person")).agg(F.max("ga").alias("gender"), _n().alias("partners"), F.round(F.count_if(F.col("ga") == F.col("gb")) / _n(), 6).alias("same_share"))


# Shares of core number, degree and clustering, and the least score of core and of semi-periphery.
CORE_PARTS, CORE, SEMI = (0.4, 0.3, 0.3), 0.7, 0.4


def coreness(d: Domain, g: blocks.Blocks) -> DataFrame:
    """(person, i, core, degree, clustering, score, status)."""
    x = blocks.cores(g).join(blocks.closed(g), "i").join(blocks.degrees(g), "i")
    cc = F.when(F.col("k") > 1, F.col("t") * 2 / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    x = g.shelf.put(x.select(F.col("node").alias("person"), "i", "core", F.col("k").alias("degree"), cc.alias("clustering")), "parts")
    top = x.agg(F.max("core").alias("tc"), F.max("degree").alias("td"))
    a, b, c = CORE_PARTS
    score = F.round(a * F.col("core") / F.col("tc") + b * F.col("degree") / F.col("td") + c * F.col("clustering"), 4)
    x = x.crossJoin(F.broadcast(top)).withColumn("score", score).drop("tc", "td")  # one row
    return x.withColumn("status", F.when(F.col("score") >= CORE, "core").when(F.col("score") >= SEMI, "semi_periphery").otherwise("periphery"))


@R.query()
def core_periphery(d: Domain) -> DataFrame:
    """Core number, degree, clustering and standing of each person, and the share of partners in the core."""
    g = graph(d, Shelf(d.spark, "standing"))
    x = g.shelf.put(coreness(d, g), "scored")
    near = blocks.share_of_partners(g, x.select("i", (F.col("status") == "core").alias("x")))
    x = x.join(near, "i").withColumn("core_share", F.round("share", 6))
    return x.select("person", "core", "degree", F.round("clustering", 6).alias("clustering"), "score", "status", "core_share")


@R.query()
def pair_connectivity(d: Domain) -> DataFrame:
    """Components, the largest one, and pairs that some path joins."""
    n = it.components(ties(d), Shelf(d.spark, "pairs")).groupBy("component").agg(_n().alias("n"))
    return n.agg(_n().alias("components"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).alias("joined_pairs"))


@R.query()
def paths_from_hub(d: Domain) -> DataFrame:
    """Shortest paths from the best connected person to every person some path reaches (itself in 0 steps): steps, number and the least of them."""
    g = graph(d, Shelf(d.spark, "paths"))
    hub = blocks.most_tied(g)
    if hub is None:
        return d.spark.createDataFrame([], "source string, target string, hops int, paths long, path string")
    x = blocks.paths_from(g, hub["i"], d.person.select(F.col("person").alias("target")))
    return x.select(F.lit(hub["node"]).alias("source"), "target", "hops", "paths", F.array_join("path", ",").alias("path"))


@R.query(_TEAM + ", cw AS (SELECT DISTINCT t.person, t.work, k.year FROM team t JOIN work k ON k.work = t.work WHERE t.core AND k.year IS NOT NULL), lc AS (SELECT person, count(*) AS works, count(*) FILTER (WHERE year >= 2015) AS recent, max(year) - min(year) + 1 AS years FROM cw GROUP BY person) SELECT person, works, recent, CAST(years AS INTEGER) AS years, round(works / years, 6) AS per_year FROM lc WHERE works >= 3")
def core_activity(d: Domain) -> DataFrame:
    """Core works of persons with at least three."""
    x = team(d).filter("core").join(d.work.filter("year is not null").select("work", "year"), "work").select("person", "work", "year").distinct()
    g = x.groupBy("person").agg(_n().alias("works"), F.count_if(F.col("year") >= 2015).alias("recent"), (F.max("year") - F.min("year") + 1).cast("int").alias("years"))
    return g.filter("works >= 3").withColumn("per_year", F.round(F.col("works") / F.col("years"), 6))


QUERIES, SQL = R.queries, R.sql
