"""Validation, audits, consensus, resolution and statistical monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..functions.textual import canonical_id, date_precision, difference_kind, parse_date
from .career_queries import _SPAN, _YEAR, person_years, spans
from .domain import Domain
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")


# --- validation -------------------------------------------------------------


@R.query(", k AS (SELECT DISTINCT person FROM person), w AS (SELECT DISTINCT work FROM work) SELECT count(*) AS n_credits, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.person = c.person)) AS no_person, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.work = c.work)) AS no_work FROM credit c")
def referential_integrity(d: Domain) -> DataFrame:
    c = d.credit.groupBy("person", "work").agg(_n().alias("n"))
    p, w = d.person.select("person", F.lit(1).alias("hp")), d.work.select("work", F.lit(1).alias("hw")).distinct()
    x = c.join(p, "person", "left").join(w, "work", "left")
    return x.agg(F.sum("n").alias("n_credits"), F.coalesce(F.sum(F.when(F.col("hp").isNull(), F.col("n"))), F.lit(0)).alias("no_person"), F.coalesce(F.sum(F.when(F.col("hw").isNull(), F.col("n"))), F.lit(0)).alias("no_work"))


@R.query(" SELECT count(*) AS works, count(*) FILTER (WHERE coalesce(trim(title), '') = '') AS no_title, count(*) FILTER (WHERE year IS NULL) AS no_year, count(*) FILTER (WHERE episodes IS NULL) AS no_episodes, count(*) FILTER (WHERE duration IS NULL) AS no_duration FROM work")
def data_completeness(d: Domain) -> DataFrame:
    return d.work.agg(_n().alias("works"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("no_title"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("year", "episodes", "duration")])


@R.query(", x AS (SELECT person, work, count(*) AS n, count(DISTINCT role) AS roles FROM credit GROUP BY ALL) SELECT person, work, n, roles FROM x WHERE roles >= 5")
def many_roles(d: Domain) -> DataFrame:
    """People with five or more roles on one work."""
    return d.credit.groupBy("person", "work").agg(_n().alias("n"), F.countDistinct("role").alias("roles")).filter("roles >= 5")


@R.query(", x AS (SELECT person, count(*) AS n FROM credit GROUP BY person), a AS (SELECT avg(n) AS m FROM x) SELECT person, n, round(n / m, 6) AS ratio FROM x CROSS JOIN a WHERE n > 50 * m OR n >= 20 * m ORDER BY n DESC, person LIMIT 5")
def credit_distribution(d: Domain) -> DataFrame:
    """Report of the five persons with most credits among those far above the mean."""
    x = d.credit.groupBy("person").agg(_n().alias("n"))
    m = x.agg(F.avg("n").alias("m"))
    return x.crossJoin(F.broadcast(m)).filter("n >= 20 * m").orderBy(F.desc("n"), "person").limit(5).select("person", "n", F.round(F.col("n") / F.col("m"), 6).alias("ratio"))


@R.query(" SELECT source, count(*) AS n, max(year) AS last_year, coalesce(max(year) < 2024, true) AS stale FROM credit GROUP BY source")
def data_freshness(d: Domain) -> DataFrame:
    return d.credit.groupBy("source").agg(_n().alias("n"), F.max("year").alias("last_year"), F.coalesce(F.max("year") < 2024, F.lit(True)).alias("stale"))


@R.query(", x AS (SELECT person, source, count(*) AS n FROM credit GROUP BY ALL), y AS (SELECT person, count(*) AS sources, max(n) / sum(n) AS share FROM x GROUP BY person) SELECT count(*) AS persons, count(*) FILTER (WHERE sources = 1) AS single_source, round(avg(share), 6) AS mean_top_share FROM y")
def source_dependence(d: Domain) -> DataFrame:
    x = d.credit.groupBy("person", "source").agg(_n().alias("n")).groupBy("person").agg(_n().alias("sources"), (F.max("n") / F.sum("n")).alias("share"))
    return x.agg(_n().alias("persons"), F.count_if(F.col("sources") == 1).alias("single_source"), F.round(F.avg("share"), 6).alias("mean_top_share"))


@R.query(", x AS (SELECT source, category, year, count(*) AS n FROM credit WHERE year IS NOT NULL GROUP BY ALL), r AS (SELECT category, year, coalesce(max(CASE WHEN source = 'anilist' THEN n END), max(n)) AS ref FROM x GROUP BY ALL) SELECT x.source, x.category, x.year, x.n, round(x.n / r.ref, 6) AS coverage FROM x JOIN r ON r.category = x.category AND r.year = x.year")
def coverage_matrix(d: Domain) -> DataFrame:
    """Credits by source, role group and year relative to the reference source."""
    x = d.credit.filter("year is not null").groupBy("source", "category", "year").agg(_n().alias("n"))
    w = Window.partitionBy("category", "year")
    ref = F.coalesce(F.max(F.when(F.col("source") == "anilist", F.col("n"))).over(w), F.max("n").over(w))
    return x.withColumn("coverage", F.round(F.col("n") / ref, 6))


# --- monitoring ---------------------------------------------------------------


@R.query(_YEAR + ", y AS (SELECT year, CAST(sum(n) AS BIGINT) AS n FROM py GROUP BY year), m AS (SELECT avg(n) AS m FROM y) SELECT year, n, round((n - m) / sqrt(m), 6) AS z, abs(n - m) / sqrt(m) > 3 AS outlier FROM y CROSS JOIN m")
def poisson_outliers(d: Domain) -> DataFrame:
    y = d.crew.filter("year is not null").groupBy("year").agg(_n().alias("n"))
    m = y.agg(F.avg("n").alias("m"))
    z = (F.col("n") - F.col("m")) / F.sqrt("m")
    return y.crossJoin(F.broadcast(m)).select("year", "n", F.round(z, 6).alias("z"), (F.abs(z) > 3).alias("outlier"))


@R.query(", x AS (SELECT source, role, count(*) AS n FROM credit GROUP BY ALL), p AS (SELECT source, role, n / sum(n) OVER (PARTITION BY source) AS p FROM x), q AS (SELECT role, sum(n) / (SELECT sum(n) FROM x) AS q FROM x GROUP BY role) SELECT p.source, round(sum(p * ln(p / q)), 6) AS divergence FROM p JOIN q ON q.role = p.role GROUP BY p.source")
def role_divergence(d: Domain) -> DataFrame:
    """Kullback-Leibler divergence of each source's roles from all roles."""
    x = d.credit.groupBy("source", "role").agg(_n().alias("n"))
    q = F.sum("n").over(Window.partitionBy("role")) / F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row a source and role
    x = x.withColumns({"p": F.col("n") / F.sum("n").over(Window.partitionBy("source")), "q": q})
    return x.groupBy("source").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 6).alias("divergence"))


@R.query(_SPAN + ", h AS (SELECT credits AS v, row_number() OVER (ORDER BY credits) - 1 AS i, count(*) OVER () AS m FROM span), q AS (SELECT max(CASE WHEN i = m // 4 THEN v END) AS q1, max(CASE WHEN i = 3 * m // 4 THEN v END) AS q3, avg(v) AS mu, stddev_pop(v) AS sd FROM h) SELECT person, credits, credits > q3 + 1.5 * (q3 - q1) AS iqr_outlier, abs(credits - mu) / sd > 2.5 AS z_outlier FROM span CROSS JOIN q WHERE credits > q3 + 1.5 * (q3 - q1) OR credits < q1 - 1.5 * (q3 - q1) OR abs(credits - mu) / sd > 2.5")
def outliers(d: Domain) -> DataFrame:
    """Persons outside the index-quartile fences or 2.5 deviations."""
    s = spans(d).select("person", "credits")
    h = s.groupBy("credits").agg(_n().alias("k"))
    h = h.withColumns({"hi": F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("credits")), "m": F.sum("k").over(Window.partitionBy(F.lit(1)))})  # one row a distinct value
    at = lambda i: F.max(F.when((i >= F.col("hi") - F.col("k")) & (i < F.col("hi")), F.col("credits")))
    q = h.agg(at(F.expr("m div 4")).alias("q1"), at(F.expr("3 * m div 4")).alias("q3")).crossJoin(s.agg(F.avg("credits").alias("mu"), F.stddev_pop("credits").alias("sd")))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    high, low, z = F.col("credits") > F.col("q3") + fence, F.col("credits") < F.col("q1") - fence, F.abs(F.col("credits") - F.col("mu")) / F.col("sd") > 2.5
    return s.crossJoin(F.broadcast(q)).filter(high | low | z).select("person", "credits", high.alias("iqr_outlier"), z.alias("z_outlier"))


@R.query(_YEAR + ", y AS (SELECT year, avg(n) AS x FROM py GROUP BY year), m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM y) SELECT year, round(sum((x - mu) / sd) OVER (ORDER BY year), 6) AS cusum FROM y CROSS JOIN m")
def cusum(d: Domain) -> DataFrame:
    """Cumulative standardised deviation of the yearly mean of credits."""
    y = person_years(d).groupBy("year").agg(F.avg("n").alias("x"))
    m = y.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = (F.col("x") - F.col("mu")) / F.col("sd")
    return y.crossJoin(F.broadcast(m)).select("year", F.round(F.sum(z).over(Window.partitionBy(F.lit(1)).orderBy("year")), 6).alias("cusum"))


@R.query(_YEAR + ", y AS (SELECT year, avg(n) AS x FROM py GROUP BY year), w AS (SELECT year, avg(x) OVER (ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, avg(x) OVER (ORDER BY year ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS b, count(*) OVER (ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS na, count(*) OVER (ORDER BY year ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS nb FROM y) SELECT year, round(b - a, 6) AS shift FROM w WHERE na = 5 AND nb = 5")
def sliding_break(d: Domain) -> DataFrame:
    """Change of the mean between the five years before and after each year."""
    y = person_years(d).groupBy("year").agg(F.avg("n").alias("x"))
    w = Window.partitionBy(F.lit(1)).orderBy("year")
    a, b = w.rowsBetween(-5, -1), w.rowsBetween(0, 4)
    x = y.withColumns({"s": F.avg("x").over(b) - F.avg("x").over(a), "na": F.count("x").over(a), "nb": F.count("x").over(b)})
    return x.filter("na = 5 and nb = 5").select("year", F.round("s", 6).alias("shift"))


_P = _YEAR + """, r AS (SELECT year, avg(ln(1 + n)) AS m, count(*) AS k, stddev_samp(ln(1 + n)) AS sd FROM py GROUP BY year HAVING count(*) >= 5), g AS (SELECT avg(ln(1 + n)) AS g FROM py),
p AS (SELECT year, 1 / (1 + exp(abs(1.702 * (m - g) / (sd / sqrt(k))))) * 2 AS p FROM r CROSS JOIN g WHERE sd > 0)"""


def year_tests(d: Domain) -> DataFrame:
    """(year, p): two-sided p of a year's mean log credits against the overall mean, by the logistic approximation of the normal."""
    x = person_years(d).withColumn("v", F.log1p("n"))
    r = x.groupBy("year").agg(F.avg("v").alias("m"), _n().alias("k"), F.stddev_samp("v").alias("sd")).filter("k >= 5 and sd > 0")
    z = 1.702 * (F.col("m") - F.col("g")) / (F.col("sd") / F.sqrt("k"))
    return r.crossJoin(F.broadcast(x.agg(F.avg("v").alias("g")))).select("year", (2 / (1 + F.exp(F.abs(z)))).alias("p"))


def benjamini_hochberg(tests: DataFrame, key: str, p: str = "p") -> DataFrame:
    """``tests`` with q: monotone adjusted p-values."""
    w = Window.partitionBy(F.lit(1)).orderBy(p, key)
    r = tests.withColumn("raw", F.col(p) * F.count("*").over(Window.partitionBy(F.lit(1))) / F.row_number().over(w))
    return r.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(w.rowsBetween(0, Window.unboundedFollowing)))).drop("raw")


@R.query(_P + ", k AS (SELECT *, row_number() OVER (ORDER BY p, year) AS i, count(*) OVER () AS m FROM p) SELECT year, round(p, 6) AS p, round(least(1.0, min(p * m / i) OVER (ORDER BY p, year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q, round(least(1.0, max(p * (m - i + 1)) OVER (ORDER BY p, year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS holm FROM k")
def multiple_testing(d: Domain) -> DataFrame:
    """False-discovery and family-wise adjustment of the yearly tests."""
    t = benjamini_hochberg(year_tests(d), "year")
    w = Window.partitionBy(F.lit(1)).orderBy("p", "year")  # one row a test
    raw = F.col("p") * (F.count("*").over(Window.partitionBy(F.lit(1))) - F.row_number().over(w) + 1)
    t = t.withColumn("raw", raw)
    return t.select("year", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), F.round(F.least(F.lit(1.0), F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))), 6).alias("holm"))


@R.query(_SPAN + ", x AS (SELECT credits, count(*) AS k FROM span GROUP BY credits), c AS (SELECT credits, k, sum(k) OVER (ORDER BY credits) AS hi, sum(k) OVER () AS m FROM x), mm AS (SELECT min(credits) AS lo, max(credits) AS hi, avg(credits) AS mu, stddev_pop(credits) AS sd FROM span) SELECT s.person, round(100.0 * c.hi / c.m, 1) AS percentile, round(100.0 * (s.credits - mm.lo) / (mm.hi - mm.lo), 2) AS minmax, round(least(greatest(((s.credits - mu) / sd + 2) / 4 * 100, 0.0), 100.0), 4) AS zscore FROM span s JOIN c ON c.credits = s.credits CROSS JOIN mm")
def normalised_scores(d: Domain) -> DataFrame:
    """Percentile, min-max and z scores of a person's credits; percentiles come from counts of distinct values."""
    s = spans(d).select("person", "credits")
    h = s.groupBy("credits").agg(_n().alias("k"))
    h = h.select("credits", (100.0 * F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("credits")) / F.sum("k").over(Window.partitionBy(F.lit(1)))).alias("pc"))
    m = s.agg(F.min("credits").alias("lo"), F.max("credits").alias("hi"), F.avg("credits").alias("mu"), F.stddev_pop("credits").alias("sd"))
    c = F.col("credits")
    return s.join(h, "credits").crossJoin(F.broadcast(m)).select("person", F.round("pc", 1).alias("percentile"), F.round(100.0 * (c - F.col("lo")) / (F.col("hi") - F.col("lo")), 2).alias("minmax"), F.round(F.least(F.greatest(((c - F.col("mu")) / F.col("sd") + 2) / 4 * 100, F.lit(0.0)), F.lit(100.0)), 4).alias("zscore"))


@R.query(_SPAN + " SELECT person, round(least(1.0, 1 - exp(-3.0 / 20 * credits)), 3) AS confidence, round(greatest(0.0, 50 - 50 * (1 - least(1.0, 1 - exp(-3.0 / 20 * credits)))), 3) AS low FROM span")
def confidence(d: Domain) -> DataFrame:
    c = F.least(F.lit(1.0), 1 - F.exp(F.lit(-3.0 / 20) * F.col("credits")))
    return spans(d).select("person", F.round(c, 3).alias("confidence"), F.round(F.greatest(F.lit(0.0), 50 - 50 * (1 - c)), 3).alias("low"))


# --- audits and resolution ------------------------------------------------------


@R.query(" SELECT person, work, role, source, coalesce(episode, -1) AS episode, count(*) AS n FROM credit GROUP BY ALL HAVING count(*) > 1")
def credit_duplicates(d: Domain) -> DataFrame:
    return d.credit.groupBy("person", "work", "role", "source", F.coalesce("episode", F.lit(-1)).alias("episode")).agg(_n().alias("n")).filter("n > 1")


@R.query(" SELECT person, work, role, coalesce(episode, -1) AS episode, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n FROM credit GROUP BY ALL")
def merged_credits(d: Domain) -> DataFrame:
    """One row per person, work, role and episode with its sources."""
    return d.credit.groupBy("person", "work", "role", F.coalesce("episode", F.lit(-1)).alias("episode")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), _n().alias("n"))


_NAME = "lower(regexp_replace(trim({}), '[ \\t\\u3000]+', '', 'g'))".replace("\\t", "\t").replace("\\u3000", "　")


def _name(c: str):  # noqa: ANN202
    return F.lower(F.regexp_replace(F.trim(c), "[ \t　]+", ""))


@R.query(f", x AS (SELECT DISTINCT {_NAME.format('name_ja')} AS name, person, split_part(person, ':', 1) AS source FROM person WHERE coalesce(name_ja, '') <> '') SELECT name, count(*) AS n, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(person)), ',') AS ids FROM x WHERE name <> '' GROUP BY name HAVING count(DISTINCT source) > 1")
def person_duplicates(d: Domain) -> DataFrame:
    """Names held by ids of several sources."""
    x = d.person.filter(F.coalesce("name_ja", F.lit("")) != "").select(_name("name_ja").alias("name"), "person", F.split_part("person", F.lit(":"), F.lit(1)).alias("source")).distinct().filter("name <> ''")
    return x.groupBy("name").agg(_n().alias("n"), F.countDistinct("source").alias("n_sources"), F.array_join(F.sort_array(F.collect_list("person")), ",").alias("ids")).filter("n_sources > 1")


@R.query(f", x AS (SELECT {_NAME.format('name')} AS name, lower(trim(id)) AS id FROM studios WHERE coalesce(trim(name), '') <> '') SELECT name, count(*) AS n, min(id) AS id_a, max(id) AS id_b FROM x GROUP BY name HAVING count(*) > 1")
def studio_duplicates(d: Domain) -> DataFrame:
    x = d.raw("studios").filter(F.coalesce(F.trim("name"), F.lit("")) != "").select(_name("name").alias("name"), clean_id("id").alias("id"))
    return x.groupBy("name").agg(_n().alias("n"), F.min("id").alias("id_a"), F.max("id").alias("id_b")).filter("n > 1")


_CAN = f", x AS (SELECT {_NAME.format('name_ja')} AS name, person FROM person WHERE coalesce(name_ja, '') <> '')"


@R.query(_CAN + " SELECT name, count(*) AS n, 'p:' || substr(sha256(array_to_string(list_sort(list(person)), chr(31))), 1, 12) AS canonical FROM x WHERE name <> '' GROUP BY name")
def canonical_persons(d: Domain) -> DataFrame:
    """One canonical id per normalised name; two-letter hash salted by all member ids."""
    x = d.person.filter(F.coalesce("name_ja", F.lit("")) != "").select(_name("name_ja").alias("name"), "person").filter("name <> ''")
    return x.groupBy("name").agg(_n().alias("n"), canonical_id(F.collect_list("person"), "p:").alias("canonical"))


@R.query(", f AS (SELECT lower(trim(id)) AS id, source, title_ja, year, episodes, fetched_at, content_hash FROM bronze_anime WHERE trim(id) <> '') SELECT id, source, title_ja, year, episodes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, coalesce(content_hash, ''), coalesce(title_ja, ''), coalesce(episodes, -9)) AS k FROM f) WHERE k = 1")
def latest_bronze(d: Domain) -> DataFrame:
    """The last fetch of each raw record; by aggregation, not a window."""
    f = d.raw("bronze_anime").select(clean_id("id").alias("id"), "source", "title_ja", "year", "episodes", (-F.unix_micros(F.col("fetched_at").cast("timestamp"))).alias("t"), F.coalesce("content_hash", F.lit("")).alias("h")).filter("id is not null")
    best = F.min(F.struct("t", "h", F.coalesce("title_ja", F.lit("")).alias("a"), F.coalesce("episodes", F.lit(-9)).alias("b"), "source", "title_ja", "year", "episodes"))
    return f.groupBy("id").agg(best.alias("m")).select("id", "m.source", "m.title_ja", "m.year", "m.episodes")


@R.query(", f AS (SELECT lower(trim(id)) AS id, count(*) AS fetches, count(DISTINCT coalesce(title_ja, '')) AS titles, count(DISTINCT coalesce(year, -1)) AS years, count(DISTINCT coalesce(episodes, -9)) AS eps FROM bronze_anime WHERE trim(id) <> '' GROUP BY 1) SELECT * FROM f WHERE fetches > 1 AND (titles > 1 OR years > 1 OR eps > 1)")
def changed_bronze(d: Domain) -> DataFrame:
    """Raw records whose values changed between fetches."""
    f = d.raw("bronze_anime").select(clean_id("id").alias("id"), F.coalesce("title_ja", F.lit("")).alias("a"), F.coalesce("year", F.lit(-1)).alias("b"), F.coalesce("episodes", F.lit(-9)).alias("c")).filter("id is not null")
    return f.groupBy("id").agg(_n().alias("fetches"), F.countDistinct("a").alias("titles"), F.countDistinct("b").alias("years"), F.countDistinct("c").alias("eps")).filter("fetches > 1 and (titles > 1 or years > 1 or eps > 1)")


_PD = """, p AS (SELECT lower(trim(id)) AS id, nullif(coalesce(nullif(regexp_extract(start_date, '"year"\\s*:\\s*(\\d{4})', 1), ''), nullif(regexp_extract(start_date, '^\\s*(\\d{4})', 1), '')), '') AS y,
coalesce(nullif(regexp_extract(start_date, '"month"\\s*:\\s*(\\d{1,2})', 1), ''), nullif(regexp_extract(start_date, '^\\s*\\d{4}\\s*[-/.年]\\s*(\\d{1,2})', 1), '')) AS m,
coalesce(nullif(regexp_extract(start_date, '"day"\\s*:\\s*(\\d{1,2})', 1), ''), nullif(regexp_extract(start_date, '^\\s*\\d{4}\\s*[-/.年]\\s*\\d{1,2}\\s*[-/.月]\\s*(\\d{1,2})', 1), '')) AS d FROM bronze_anime)
SELECT DISTINCT id, CASE WHEN y IS NOT NULL THEN y || '-' || coalesce(lpad(m, 2, '0'), 'XX') || '-' || CASE WHEN m IS NULL THEN 'XX' ELSE coalesce(lpad(d, 2, '0'), 'XX') END END AS iso,
CASE WHEN y IS NULL THEN 0 WHEN m IS NULL THEN 1 WHEN d IS NULL THEN 2 ELSE 3 END AS precision_ FROM p"""


@R.query(_PD)
def parsed_dates(d: Domain) -> DataFrame:
    iso = parse_date(F.col("start_date"))
    return d.raw("bronze_anime").select(clean_id("id").alias("id"), iso.alias("iso"), date_precision(iso).cast("int").alias("precision_")).distinct()


@R.query(""", v AS (SELECT person, work, role, source, year FROM credit WHERE year IS NOT NULL), k AS (SELECT work, year, count(DISTINCT source) AS n FROM v GROUP BY ALL),
s AS (SELECT work, count(*) AS n_values, sum(n) AS total, max(n) AS top, arg_max(year, (n, -year)) AS value FROM k GROUP BY work), t AS (SELECT k.work, count(*) AS tied FROM k JOIN s ON s.work = k.work AND k.n = s.top GROUP BY k.work)
SELECT s.work, s.value, CASE WHEN n_values = 1 THEN 'unanimous' WHEN tied > 1 THEN 'tie' WHEN top / total > 0.5 THEN 'majority' ELSE 'plurality' END AS kind FROM s JOIN t ON t.work = s.work""")
def year_consensus(d: Domain) -> DataFrame:
    """Consensus of the sources on each work's year; ties go to the earlier year."""
    k = d.credit.filter("year is not null").groupBy("work", "year").agg(F.countDistinct("source").alias("n"))
    k = k.withColumn("top", F.max("n").over(Window.partitionBy("work")))
    s = k.groupBy("work").agg(_n().alias("n_values"), F.sum("n").alias("total"), F.max("n").alias("m"), F.max_by("year", F.struct("n", -F.col("year"))).alias("value"), F.count_if(F.col("n") == F.col("top")).alias("tied"))
    kind = F.when(F.col("n_values") == 1, "unanimous").when(F.col("tied") > 1, "tie").when(F.col("m") / F.col("total") > 0.5, "majority").otherwise("plurality")
    return s.select("work", "value", kind.alias("kind"))


@R.query(""", a AS (SELECT lower(trim(canonical_id)) AS id, CAST(year AS VARCHAR) AS y FROM anime WHERE year IS NOT NULL), f AS (SELECT work AS id, CAST(mode_y AS VARCHAR) AS y FROM (SELECT work, arg_max(year, (n, -year)) AS mode_y FROM (SELECT lower(trim(anime_id)) AS work, credit_year AS year, count(*) AS n FROM credits WHERE credit_year > 0 AND trim(anime_id) <> '' GROUP BY ALL) GROUP BY work))
SELECT CASE WHEN a.y = f.y THEN 'identical' WHEN length(a.y) <> length(f.y) THEN 'digit_count' WHEN length(a.y) = 4 AND abs(CAST(a.y AS INTEGER) - CAST(f.y AS INTEGER)) = 1 THEN 'off_by_year' WHEN levenshtein(a.y, f.y) = 1 AND length(a.y) > 3 THEN 'single_char' WHEN levenshtein(a.y, f.y) <= 0.3 * greatest(length(a.y), length(f.y)) THEN 'multi_char' ELSE 'different' END AS kind, count(*) AS n FROM a JOIN f ON f.id = a.id GROUP BY 1""")
def year_differences(d: Domain) -> DataFrame:
    """How a work's year differs from its credits' most frequent year."""
    a = d.raw("anime").filter("year is not null").select(clean_id("canonical_id").alias("work"), F.col("year").cast("string").alias("a"))
    f = d.raw("credits").filter("credit_year > 0").groupBy(clean_id("anime_id").alias("work"), "credit_year").agg(_n().alias("n")).filter("work is not null")
    f = f.groupBy("work").agg(F.max_by("credit_year", F.struct("n", -F.col("credit_year"))).cast("string").alias("b"))
    return a.join(f, "work").groupBy(difference_kind(F.col("a"), F.col("b")).alias("kind")).agg(_n().alias("n"))


@R.query(", s AS (SELECT DISTINCT work FROM studio) SELECT w.format, count(*) AS works, count(s.work) AS with_studio FROM work w LEFT JOIN s ON s.work = w.work GROUP BY w.format")
def studio_coverage(d: Domain) -> DataFrame:
    s = d.studio.select("work").distinct().withColumn("has", F.lit(1))
    return d.work.join(s, "work", "left").groupBy("format").agg(_n().alias("works"), F.count("has").alias("with_studio"))


@R.query(" SELECT p.person, min(c.year) || '-' || max(c.year) AS years_active FROM person p JOIN credit c ON c.person = p.person WHERE c.year IS NOT NULL GROUP BY p.person")
def years_active(d: Domain) -> DataFrame:
    c = d.credit.filter("year is not null").groupBy("person").agg(F.concat_ws("-", F.min("year"), F.max("year")).alias("years_active"))
    return c.join(d.person.select("person"), "person")


@R.query(", r AS (SELECT DISTINCT lower(trim(redirect_from_id)) AS f, lower(trim(redirect_to_id)) AS t FROM meta_entity_resolution_audit WHERE lower(trim(table_name)) = 'anime' AND trim(redirect_from_id) <> '' AND trim(redirect_to_id) <> ''), o AS (SELECT f, min(t) AS t FROM r WHERE f <> t GROUP BY f) SELECT c.person, coalesce(o.t, c.work) AS work, count(*) AS n FROM credit c LEFT JOIN o ON o.f = c.work GROUP BY ALL")
def canonical_credits(d: Domain) -> DataFrame:
    """Credits counted under the redirected work id (one step; the smallest target)."""
    r = d.raw("meta_entity_resolution_audit").filter(clean_id("table_name") == "anime").select(clean_id("redirect_from_id").alias("work"), clean_id("redirect_to_id").alias("t")).filter("work <> t").groupBy("work").agg(F.min("t").alias("t"))
    c = d.credit.groupBy("person", "work").agg(_n().alias("n")).join(r, "work", "left")
    return c.groupBy("person", F.coalesce("t", "work").alias("work")).agg(F.sum("n").alias("n"))


@R.query(""", x AS (SELECT work, list_sort(list(DISTINCT g)) AS g FROM (SELECT work, unnest([coalesce(format, 'unknown'), coalesce(source_mat, 'unknown'), coalesce(work_type, 'unknown')]) AS g FROM (SELECT lower(trim(canonical_id)) AS work, nullif(format, '') AS format, source_mat, work_type FROM anime)) GROUP BY work),
e AS (SELECT work, unnest(g) AS g FROM x), n AS (SELECT count(*) AS n FROM x), k AS (SELECT g, count(*) AS k FROM e GROUP BY g), p AS (SELECT a.g AS a, b.g AS b, count(*) AS c FROM e a JOIN e b ON a.work = b.work AND a.g < b.g GROUP BY ALL HAVING count(*) >= 5)
SELECT p.a AS tag_a, p.b AS tag_b, p.c AS n, round(log2(p.c * n.n / (ka.k * kb.k)), 6) AS pmi FROM p CROSS JOIN n JOIN k ka ON ka.g = p.a JOIN k kb ON kb.g = p.b""")
def tag_pmi(d: Domain) -> DataFrame:
    """Pointwise mutual information of work tags (format, source material, type)."""
    tags = F.array_distinct(F.array(*[F.coalesce(c, F.lit("unknown")) for c in (F.nullif(F.col("format"), F.lit("")), F.col("source_mat"), F.col("work_type"))]))
    x = d.raw("anime").select(clean_id("canonical_id").alias("work"), tags.alias("tags"))
    e = x.select("work", F.explode("tags").alias("g"))
    k = e.groupBy("g").agg(_n().alias("k"))
    p = e.select("work", F.col("g").alias("tag_a")).join(e.select("work", F.col("g").alias("tag_b")), "work").filter("tag_a < tag_b").groupBy("tag_a", "tag_b").agg(_n().alias("n")).filter("n >= 5")
    p = p.join(k.withColumnsRenamed({"g": "tag_a", "k": "ka"}), "tag_a").join(k.withColumnsRenamed({"g": "tag_b", "k": "kb"}), "tag_b")
    return p.crossJoin(F.broadcast(x.agg(_n().alias("total")))).select("tag_a", "tag_b", "n", F.round(F.log2(F.col("n") * F.col("total") / (F.col("ka") * F.col("kb"))), 6).alias("pmi"))


QUERIES, SQL = R.queries, R.sql
