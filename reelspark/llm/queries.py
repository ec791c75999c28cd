"""The queries of the dealt problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..session import table
from . import cooccur, groups, linkage, mixing, names, spans, survivor, tokens, visual


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "meta_entity_resolution_audit"), "redirect_from_id", "redirect_to_id", "table_name")


def _together(spark: SparkSession, d: str) -> DataFrame:
    got = cooccur.together(table(spark, d, "credits"), "role", "anime_id", "person_id")
    return got.withColumnsRenamed({"s": "role", "a": "person_a", "b": "person_b"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).select("role", "person_a", "person_b")


def p2_surprise(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with shared works, ratio to chance, the null's mean, p-value and q-value."""
    return _together(spark, d).select("role", "person_a", "person_b", F.col("c").alias("shared"), "lift", "expected", "p_value", "q_value")


def p2_significant(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that a false-discovery rate of one in a hundred keeps."""
    return p2_surprise(spark, d).filter(F.col("q_value") <= 0.01)


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches with their confidence."""
    return linkage.link_records(table(spark, d, "anime"), table(spark, d, "bronze_anime"), "canonical_id", "id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("canonical_id", "raw_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.cluster_pairs(names.name_clusters(table(spark, d, "characters"), table(spark, d, "character_voice_actors")))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.name_clusters(table(spark, d, "characters"), table(spark, d, "character_voice_actors"))


def _group_rows(spark: SparkSession, d: str) -> DataFrame:
    audit = table(spark, d, "meta_entity_resolution_audit").filter(clean_id("table_name") == "anime")
    member = groups.match_groups(audit, "redirect_from_id", "redirect_to_id", "table_name").select("group_id", F.col("record_id").alias("key"))
    rows = table(spark, d, "anime").select(clean_id("canonical_id").alias("key"), F.col("canonical_id").alias("row_id"), F.col("built_at").alias("at"), "source_count", *survivor.FIELDS, *[f"{f}_source" for f in survivor.FIELDS])
    return rows.join(member, "key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The stated order settles rows without ``built_at`` by id, so nothing is left for the learned precedence (see p5_record)."""
    return survivor.survivors(_group_rows(spark, d), table(spark, d, "source_rank"), currency=False).select("group_id", "field_name", "from_id")


def p5_record(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record a group."""
    best = survivor.survivors(_group_rows(spark, d), table(spark, d, "source_rank"))
    return best.groupBy("group_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in survivor.FIELDS])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "anime").select(F.lit("anime").alias("table_name"), F.col("canonical_id").alias("id"), F.col("title_ja").alias("text"))
    return a.unionByName(table(spark, d, "studios").select(F.lit("studios").alias("table_name"), "id", F.col("name").alias("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.lookalike_pairs(_texts(spark, d))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual.visual_classes(_texts(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"), ["doc_id"])


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    got = spans.shared_spans(table(spark, d, "documents"))
    return got.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """Per document with a shared span: number of spans, shared characters and their part of the text."""
    got = spans.shared_spans(table(spark, d, "documents"))
    return got.select("doc_id", "n_chars", F.size("spans").alias("n_spans"), "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_part"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_surprise, p2_significant, p3_found, p3_matches, p4_found, p4_clusters, p5_found, p5_record, p7_found, p7_classes, p8_ids, p9_mix, p9_shares, p10_found, p10_shared)}

_GROUPS = """
WITH RECURSIVE e AS (
  SELECT lower(trim(table_name)) AS t, lower(trim(redirect_from_id)) AS a, lower(trim(redirect_to_id)) AS b
  FROM meta_entity_resolution_audit WHERE trim(redirect_from_id) <> '' AND trim(redirect_to_id) <> ''),
links AS (SELECT t, a, b FROM e WHERE a <> b UNION SELECT t, b, a FROM e WHERE a <> b),
reach AS (SELECT t, a AS node, a AS seen FROM links UNION SELECT r.t, r.node, l.b FROM reach r JOIN links l ON l.t = r.t AND l.a = r.seen),
grp AS (SELECT t AS table_name, min(seen) AS group_id, node AS record_id FROM reach GROUP BY t, node)
"""

_FIELDS = " UNION ALL ".join(
    f"SELECT group_id, '{f}' AS field_name, canonical_id, {f}_source AS src, source_count, built_at FROM m WHERE {ok}"
    for f, ok in {
        **{f: f"regexp_matches({f}, '[\\p{{L}}\\p{{N}}]') AND lower(trim({f})) NOT IN ({', '.join(repr(w) for w in survivor.UNKNOWN)})" for f in ("title_ja", "title_en", "format")},
        "year": "year BETWEEN 1900 AND 2100",
        "episodes": f"episodes >= 1 AND episodes NOT IN {survivor.FILLERS}",
    }.items()
)

SQL = {
    "p2_found": """WITH x AS (SELECT DISTINCT role, lower(trim(anime_id)) AS w, lower(trim(person_id)) AS p FROM credits WHERE role IS NOT NULL AND trim(anime_id) <> '' AND trim(person_id) <> ''),
n AS (SELECT role, count(DISTINCT w) AS n FROM x GROUP BY role), k AS (SELECT role, p, count(*) AS k FROM x GROUP BY role, p),
c AS (SELECT a.role, a.p AS person_a, b.p AS person_b, count(*) AS c FROM x a JOIN x b ON a.role = b.role AND a.w = b.w AND a.p < b.p GROUP BY ALL)
SELECT c.role, person_a, person_b FROM c JOIN n ON n.role = c.role JOIN k ka ON ka.role = c.role AND ka.p = person_a JOIN k kb ON kb.role = c.role AND kb.p = person_b
WHERE c >= 5 AND c * n >= 4 * ka.k * kb.k""",
    "p1_found": _GROUPS + "SELECT table_name, group_id, record_id FROM grp",
    "p5_found": _GROUPS
    + f""", m0 AS (SELECT g.group_id, a.*, count(*) OVER (PARTITION BY g.group_id) AS n FROM grp g JOIN anime a ON g.table_name = 'anime' AND lower(trim(a.canonical_id)) = g.record_id),
m AS (SELECT * FROM m0 WHERE n >= 2), long AS ({_FIELDS}),
best AS (SELECT l.*, row_number() OVER (PARTITION BY group_id, field_name ORDER BY coalesce(r.trust_rank, 1000000), coalesce(source_count, 0) DESC, built_at DESC NULLS LAST, canonical_id) AS k
  FROM long l LEFT JOIN source_rank r ON lower(trim(r.source)) = lower(trim(l.src)))
SELECT group_id, field_name, canonical_id AS from_id FROM best WHERE k = 1""",
}
