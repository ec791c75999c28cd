"""Regression, causal and clustering analyses: estimates come as small frames, residuals and clusters per entity.

SQL can't fit these; tests/test_regression.py holds the estimators against numpy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import regression as rg
from ..session import Shelf
from .career_queries import LAST, assignments, inequality, person_years, spans, transfer_events
from .domain import Domain
from .network_queries import both_ways, ties
from .registry import Registry

R = Registry()
_n = lambda: F.count("*")


def _table(d: Domain, fit: rg.Fit) -> DataFrame:
    rows = [(k, round(float(fit.coef[k]), 6), round(float(fit.se[k]), 6), round(float(fit.p[k]), 6), int(fit.n)) for k in fit.coef]
    return d.spark.createDataFrame(rows, "term string, estimate double, error double, p double, n long")


def features(d: Domain) -> DataFrame:
    """(person, y, years, studios, top, active): log credits and career features."""
    s = spans(d)
    k = assignments(d).groupBy("person").agg(F.countDistinct("studio").alias("studios"))
    return s.join(k, "person", "left").select("person", F.log1p("credits").alias("y"), (F.col("y1") - F.col("y0")).cast("double").alias("years"), F.coalesce("studios", F.lit(0)).cast("double").alias("studios"), F.col("top").cast("double").alias("top"), F.col("active").cast("double").alias("active"))


@R.query()
def opportunity_model(d: Domain) -> DataFrame:
    """Log credits on career length, studios and highest stage."""
    return _table(d, rg.ols(Shelf(d.spark, "opportunity").put(features(d), "features"), "y", ["years", "studios", "top"]))


@R.query()
def opportunity_residuals(d: Domain) -> DataFrame:
    """What a person's credits exceed the expectation by."""
    f = Shelf(d.spark, "opportunity").put(features(d), "features")
    fit = rg.ols(f, "y", ["years", "studios", "top"])
    return f.select("person", F.round(fit.expression(), 6).alias("expected"), F.round(F.col("y") - fit.expression(), 6).alias("residual"))


@R.query()
def did_model(d: Domain) -> DataFrame:
    """Works after a change of studio, within persons and years, errors clustered by person."""
    tr = transfer_events(d).select("person", "event_year")
    x = person_years(d).join(tr, "person", "left").select("person", "year", F.col("works").cast("double").alias("works"), F.coalesce((F.col("year") >= F.col("event_year")).cast("double"), F.lit(0.0)).alias("after"))
    shelf = Shelf(d.spark, "did")
    x = rg.within(shelf.put(x, "panel"), ["works", "after"], ["person", "year"], shelf)
    return _table(d, rg.ols(x, "works", ["after"], intercept=False, cluster="person"))


@R.query()
def lock_in_model(d: Domain) -> DataFrame:
    """Staying at the same studio next year on experience; a missing next year counts as leaving."""
    w = Window.partitionBy("person").orderBy("year")
    a = assignments(d).withColumns({"next": F.lead("studio").over(w), "ny": F.lead("year").over(w), "years": (F.col("year") - F.min("year").over(Window.partitionBy("person"))).cast("double")})
    a = a.filter(F.col("year") < LAST).select(F.coalesce((F.col("ny") == F.col("year") + 1) & (F.col("next") == F.col("studio")), F.lit(False)).cast("int").alias("stays"), F.log1p("years").alias("experience"))
    return _table(d, rg.logistic(Shelf(d.spark, "lock").put(a, "panel"), "stays", ["experience"], penalty=1.0))


@R.query()
def attrition_model(d: Domain) -> DataFrame:
    """Hazard of the last credit on debut stage and early volume."""
    py = person_years(d).withColumn("y0", F.min("year").over(Window.partitionBy("person")))
    e = py.filter("year <= y0 + 2").groupBy("person").agg(F.log1p(F.sum("n")).alias("early"), F.max(F.when(F.col("year") == F.col("y0"), F.col("stage"))).cast("double").alias("debut_stage"))
    x = spans(d).join(e, "person").select((F.col("y1") - F.col("y0") + 1).alias("t"), (F.col("y1") <= LAST - 3).alias("left_"), "early", "debut_stage")
    return _table(d, rg.cox(Shelf(d.spark, "attrition").put(x, "subjects"), "t", "left_", ["early", "debut_stage"]))


@R.query()
def peer_effects(d: Domain) -> DataFrame:
    """Log credits on the mean of direct partners, instrumented by the partners of partners."""
    shelf = Shelf(d.spark, "peers")
    e = shelf.put(both_ways(ties(d)).select("u", "v"), "ties")
    f = shelf.put(features(d).select("person", "y", "years"), "features")
    peer = e.join(f.select(F.col("person").alias("v"), "y"), "v").groupBy("u").agg(F.avg("y").alias("peer"))
    # the mean over partners of their partners' mean, without the person's own share
    deg = e.groupBy("u").agg(_n().alias("k"), F.lit(0).alias("_"))
    sums = peer.join(deg, "u").select(F.col("u").alias("v"), (F.col("peer") * F.col("k")).alias("s"), "k")
    far = e.join(sums, "v").join(f.select(F.col("person").alias("u"), "y"), "u").filter("k > 1").groupBy("u").agg(F.avg((F.col("s") - F.col("y")) / (F.col("k") - 1)).alias("far"))
    x = shelf.put(f.join(peer.withColumnRenamed("u", "person"), "person").join(far.withColumnRenamed("u", "person"), "person"), "panel")
    fit, strength = rg.two_stage(x, "y", "peer", "far", ["years"])
    return _table(d, fit).withColumn("first_stage_f", F.lit(round(float(strength), 4)))


@R.query()
def orthogonal_effect(d: Domain) -> DataFrame:
    """Effect of working for many studios on log credits: both residualised on the other features, cross-fitted in five folds."""
    f = features(d).withColumn("fold", F.pmod(F.xxhash64("person"), F.lit(5)))
    f = Shelf(d.spark, "dml").put(f, "features")
    parts = None
    for k in range(5):
        train, test = f.filter(F.col("fold") != k), f.filter(F.col("fold") == k)
        a, b = (rg.ols(train, c, ["years", "top", "active"]) for c in ("y", "studios"))
        part = test.select((F.col("y") - a.expression()).alias("ry"), (F.col("studios") - b.expression()).alias("rd"))
        parts = part if parts is None else parts.unionByName(part)
    return _table(d, rg.ols(parts, "ry", ["rd"], intercept=False))


@R.query()
def inequality_intervals(d: Domain) -> DataFrame:
    """Coefficient of variation of credits per entry cohort with bootstrap interval."""
    s = Shelf(d.spark, "bootstrap").put(spans(d).select((F.floor(F.col("y0") / 10) * 10).cast("int").alias("cohort"), F.col("credits").cast("double").alias("x"), "person"), "x")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(42), "r", "person"), 11).cast("double") * F.lit(2.0**-53)
    w = sum((F.when(u >= c, 1).otherwise(0) for c in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634)), F.lit(0))
    b = s.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("w", w).groupBy("cohort", "r").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("a"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("b")).filter("n > 1")
    b = b.select("cohort", (F.sqrt(F.greatest(F.col("b") / F.col("n") - F.pow(F.col("a") / F.col("n"), F.lit(2.0)), F.lit(0.0))) / (F.col("a") / F.col("n"))).alias("cv"))
    return b.groupBy("cohort").agg(F.round(F.percentile("cv", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("cv", F.lit(0.5)), 6).alias("middle"), F.round(F.percentile("cv", F.lit(0.975)), 6).alias("high"))


@R.query()
def year_inequality(d: Domain) -> DataFrame:
    """Gini, Theil and Atkinson of yearly credits."""
    return inequality(person_years(d).select(F.col("year").alias("grp"), F.col("n").cast("double").alias("x"))).withColumnRenamed("cohort", "year")


@R.query()
def studio_clusters(d: Domain) -> DataFrame:
    """Studios grouped by size, staff, stage mix and spread of years: standardised features, k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    c = d.crew.join(d.studio, "work")
    cols = ["works", "persons", "stage", "years", "per_work"]
    f = c.groupBy("studio").agg(F.log1p(F.countDistinct("work")).alias("works"), F.log1p(F.countDistinct("person")).alias("persons"), F.avg("stage").alias("stage"), F.coalesce(F.stddev_pop("year"), F.lit(0.0)).alias("years"), (_n() / F.countDistinct("work")).alias("per_work"), F.countDistinct("person").alias("k")).filter("k >= 5")
    f = Shelf(d.spark, "clusters").put(f, "features")
    n = f.count()
    if n < 6:
        return f.select("studio", F.lit(0).alias("cluster"))
    v = VectorAssembler(inputCols=cols, outputCol="raw").transform(f)
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    return KMeans(k=min(6, n), seed=42).fit(v).transform(v).select("studio", F.col("prediction").alias("cluster"))


QUERIES, SQL = R.queries, R.sql
