"""The abstract frames all domain operators take, bound to the tables.

``work``    work, title, year, season, quarter, episodes, duration, format, country
``credit``  person, work, role, category, stage, weight, episode, source, year, quarter: every credit with both ids
``crew``    the production part of ``credit``
``studio``  work, studio: distinct links
``person``  person, name_ja, name_en, nationality, gender
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..functions.roles import NON_PRODUCTION, in_list, role_frame, role_values_sql
from ..session import table

#: Episode counts used as fillers.
FILLERS = (999, 9999, 99999)


def valid_year(c: str) -> Column:
    return F.when(F.col(c).between(1900, 2100), F.col(c))


class Domain:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def work(self) -> DataFrame:
        eps = F.when((F.col("episodes") >= 1) & ~F.col("episodes").isin(*FILLERS), F.col("episodes"))
        return self.raw("anime").select(
            clean_id("canonical_id").alias("work"), F.col("title_ja").alias("title"), valid_year("year").alias("year"), F.lower("season").alias("season"),
            F.col("quarter"), eps.alias("episodes"), F.when(F.col("duration") > 0, F.col("duration")).alias("duration"), "format", F.col("country_of_origin").alias("country"),
        )

    @cached_property
    def credit(self) -> DataFrame:
        c = self.raw("credits").select(
            clean_id("person_id").alias("person"), clean_id("anime_id").alias("work"), "role", F.when(F.col("episode") >= 0, F.col("episode")).alias("episode"),
            F.col("evidence_source").alias("source"), valid_year("credit_year").alias("own_year"), F.when(F.col("credit_quarter").between(1, 4), F.col("credit_quarter")).alias("quarter"),
        )
        c = c.filter(F.col("person").isNotNull() & F.col("work").isNotNull()).join(F.broadcast(role_frame(self.spark)), "role")
        years = self.work.select("work", F.col("year").alias("work_year"))
        return c.join(years, "work", "left").withColumn("year", F.coalesce("own_year", "work_year")).drop("own_year", "work_year")

    @cached_property
    def crew(self) -> DataFrame:
        return self.credit.filter(~F.col("role").isin(*NON_PRODUCTION))

    @cached_property
    def studio(self) -> DataFrame:
        s = self.raw("anime_studios").select(clean_id("anime_id").alias("work"), clean_id("studio_id").alias("studio"), F.col("is_main").alias("main"))
        return s.dropna(subset=["work", "studio"]).groupBy("work", "studio").agg(F.max("main").alias("main"))

    @cached_property
    def person(self) -> DataFrame:
        p = self.raw("persons").select(clean_id("id").alias("person"), "name_ja", "name_en", F.upper(F.trim("nationality")).alias("nationality"), F.lower(F.trim("gender")).alias("gender"), "updated_at")
        return p.filter(F.col("person").isNotNull()).groupBy("person").agg(*[F.max_by(c, F.struct("updated_at", F.coalesce(c, F.lit("")))).alias(c) for c in ("name_ja", "name_en", "nationality", "gender")])

    @cached_property
    def cast(self) -> DataFrame:
        v = self.raw("character_voice_actors").select(clean_id("character_id").alias("character"), clean_id("person_id").alias("person"), clean_id("anime_id").alias("work"), F.upper(F.trim("character_role")).alias("role"))
        return v.dropna(subset=["character", "person", "work"]).distinct()


_EPS = "CASE WHEN episodes >= 1 AND episodes NOT IN (999, 9999, 99999) THEN episodes END"
#: The same frames in SQL, as the start of a WITH.
BASE_SQL = f"""WITH RECURSIVE role_dim(role, category, stage, weight) AS (VALUES {role_values_sql()}),
work AS (SELECT lower(trim(canonical_id)) AS work, title_ja AS title, CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year, lower(season) AS season, quarter, {_EPS} AS episodes, CASE WHEN duration > 0 THEN duration END AS duration, format, country_of_origin AS country FROM anime),
credit AS (SELECT lower(trim(c.person_id)) AS person, lower(trim(c.anime_id)) AS work, c.role, d.category, d.stage, d.weight, CASE WHEN c.episode >= 0 THEN c.episode END AS episode, c.evidence_source AS source,
  coalesce(CASE WHEN c.credit_year BETWEEN 1900 AND 2100 THEN c.credit_year END, w.year) AS year, CASE WHEN c.credit_quarter BETWEEN 1 AND 4 THEN c.credit_quarter END AS quarter
  FROM credits c JOIN role_dim d ON d.role = c.role LEFT JOIN work w ON w.work = lower(trim(c.anime_id)) WHERE trim(c.person_id) <> '' AND trim(c.anime_id) <> ''),
crew AS (SELECT * FROM credit WHERE role NOT IN {in_list(NON_PRODUCTION)}),
studio AS (SELECT lower(trim(anime_id)) AS work, lower(trim(studio_id)) AS studio, max(is_main) AS main FROM anime_studios WHERE trim(anime_id) <> '' AND trim(studio_id) <> '' GROUP BY ALL),
person AS (SELECT lower(trim(id)) AS person, arg_max(name_ja, (updated_at, coalesce(name_ja, ''))) AS name_ja, arg_max(name_en, (updated_at, coalesce(name_en, ''))) AS name_en, arg_max(struct_pack(v := upper(trim(nationality))), (updated_at, coalesce(upper(trim(nationality)), ''))).v AS nationality, arg_max(struct_pack(v := lower(trim(gender))), (updated_at, coalesce(lower(trim(gender)), ''))).v AS gender FROM persons WHERE trim(id) <> '' GROUP BY 1),
voice AS (SELECT DISTINCT lower(trim(character_id)) AS "character", lower(trim(person_id)) AS person, lower(trim(anime_id)) AS work, upper(trim(character_role)) AS role FROM character_voice_actors WHERE trim(character_id) <> '' AND trim(person_id) <> '' AND trim(anime_id) <> '')
"""
