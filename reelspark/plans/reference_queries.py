"""Problem 6 as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.references import Child, Parent, orphan_groups, orphan_report
from ..session import table


def _inputs(spark: SparkSession, d: str) -> tuple[list[Child], list[Parent], DataFrame]:
    children = [
        Child("credits", table(spark, d, "credits"), "anime_id", "updated_at", "anime"),
        Child("character_voice_actors", table(spark, d, "character_voice_actors"), "character_id", "updated_at", "characters"),
        Child("anime_studios", table(spark, d, "anime_studios"), "studio_id", "updated_at", "studios"),
    ]
    parents = [
        Parent("anime", table(spark, d, "anime"), "canonical_id", "built_at"),
        Parent("characters", table(spark, d, "characters"), "id", "updated_at"),
        Parent("studios", table(spark, d, "studios"), "id", "updated_at"),
    ]
    return children, parents, table(spark, d, "meta_entity_resolution_audit")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_groups(*_inputs(spark, d)).select("table_name", "ref_month", "ref_id", "orphan_kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(*_inputs(spark, d))


_CTE = """
WITH refs AS (
  SELECT 'credits' AS table_name, 'anime' AS parent, lower(trim(anime_id, ' \t\n\r\u00a0\u3000')) AS ref_id, updated_at AS ts FROM credits
  UNION ALL SELECT 'character_voice_actors', 'characters', lower(trim(character_id, ' \t\n\r\u00a0\u3000')), updated_at FROM character_voice_actors
  UNION ALL SELECT 'anime_studios', 'studios', lower(trim(studio_id, ' \t\n\r\u00a0\u3000')), updated_at FROM anime_studios),
par AS (
  SELECT parent, id, max(ts) AS ts FROM (
    SELECT 'anime' AS parent, lower(trim(canonical_id)) AS id, built_at AS ts FROM anime
    UNION ALL SELECT 'characters', lower(trim(id)), updated_at FROM characters
    UNION ALL SELECT 'studios', lower(trim(id)), updated_at FROM studios) GROUP BY parent, id),
red AS (
  SELECT DISTINCT parent, id FROM (
    SELECT lower(trim(table_name)) AS parent, lower(trim(redirect_from_id)) AS id FROM meta_entity_resolution_audit
    UNION ALL SELECT lower(trim(table_name)), lower(trim(redirect_to_id)) FROM meta_entity_resolution_audit) WHERE id <> ''),
marked AS (
  SELECT r.table_name, strftime(r.ts, '%Y-%m') AS ref_month, r.ref_id,
    CASE WHEN p.id IS NOT NULL THEN CASE WHEN p.ts > r.ts THEN 'late' END
         WHEN d.id IS NOT NULL THEN 'redirected' ELSE 'absent' END AS orphan_kind
  FROM refs r LEFT JOIN par p ON p.parent = r.parent AND p.id = r.ref_id
  LEFT JOIN red d ON d.parent = r.parent AND d.id = r.ref_id
  WHERE r.ref_id <> '')
"""

SQL = {
    "p6_found": _CTE + "SELECT DISTINCT table_name, ref_month, ref_id, orphan_kind FROM marked WHERE orphan_kind IS NOT NULL",
    "p6_report": _CTE
    + "SELECT table_name, ref_month, orphan_kind, CAST(count(DISTINCT ref_id) AS BIGINT) AS n_ids, CAST(count(*) AS BIGINT) AS n_refs FROM marked WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
