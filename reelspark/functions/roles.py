"""The role dimension: 24 roles with category, career stage and weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Role, category, career stage (0 outside production to 6), weight in graph edges.
ROLES = (
    ("director", "direction", 6, 3.0),
    ("episode_director", "direction", 5, 2.49),
    ("animation_director", "animation_supervision", 5, 2.8),
    ("key_animator", "animation", 3, 2.0),
    ("second_key_animator", "animation", 2, 1.4),
    ("in_between", "animation", 1, 1.0),
    ("layout", "animation", 3, 1.5),
    ("character_designer", "design", 4, 2.3),
    ("photography_director", "technical", 5, 2.0),
    ("cgi_director", "technical", 5, 2.0),
    ("background_art", "art", 3, 1.3),
    ("sound_director", "sound", 5, 1.8),
    ("music", "sound", 0, 1.21),
    ("screenplay", "writing", 4, 1.8),
    ("original_creator", "writing", 0, 1.01),
    ("producer", "production", 5, 1.5),
    ("production_manager", "production_management", 2, 1.2),
    ("finishing", "finishing", 3, 1.2),
    ("editing", "editing", 3, 1.5),
    ("settings", "settings", 3, 1.5),
    ("voice_actor", "non_production", 0, 0.5),
    ("localization", "non_production", 0, 0.5),
    ("other", "non_production", 0, 0.5),
    ("special", "non_production", 0, 0.5),
)
# Groups of roles.
NON_PRODUCTION = ("voice_actor", "original_creator", "music", "localization", "other", "special")
DIRECTORS = ("director", "episode_director", "animation_director")
ANIMATORS = ("animation_director", "key_animator", "second_key_animator", "in_between", "character_designer", "layout", "photography_director")
CORE_TEAM = ("director", "animation_director", "character_designer", "key_animator", "episode_director")
THROUGH = ("director", "character_designer", "background_art", "screenplay", "sound_director", "music", "finishing", "photography_director", "cgi_director", "producer", "original_creator", "animation_director")
EPISODIC = ("key_animator", "second_key_animator", "in_between", "episode_director", "animation_director", "layout", "photography_director", "background_art", "screenplay")


def role_frame(spark: SparkSession) -> DataFrame:
    """The dimension as a frame; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame(list(ROLES), "role string, category string, stage int, weight double")


def role_values_sql() -> str:
    """The dimension as rows of a SQL VALUES list."""
    return ", ".join(f"('{r}', '{c}', {s}, CAST({w} AS DOUBLE))" for r, c, s, w in ROLES)


def in_list(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"
