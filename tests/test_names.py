"""Person names that are alike, and Latin names in any order."""

from __future__ import annotations

import random

from types import SimpleNamespace

from pyspark.sql import functions as F

from reelspark.functions.textual import alike_keys, indel_ratio
from reelspark.plans.profile_queries import alike_names, romaji_key, romaji_matches


def people(spark, rows):
    return SimpleNamespace(person=spark.createDataFrame(rows, "person string, name_ja string, name_en string"))


def test_alike_names_ask_for_a_ratio(spark):
    rows = [
        ("mal:1", None, "kobayashi"), ("mal:2", None, "kobayasi"),  # one letter less of 17: 0.941
        ("mal:3", None, "katherinehan"), ("mal:4", None, "katherinehans"),  # of 25: 0.96
        ("ann:1", None, "katherinehanso"),  # another source
        ("mal:5", None, "maximilianfeather"), ("mal:6", None, "maximilianfeathor"),  # a substitution of 34: 0.941
        ("mal:7", None, "alexandertheophilusx"), ("mal:8", None, "alexandertheophilusy"),  # of 40: 0.95
        ("mal:9", None, "sameverylongname"), ("mal:a", None, "sameverylongname"), ("mal:b", None, "sameverylongnames"),  # not one to one
        ("mal:c", None, None), ("mal:d", "", ""),
    ]
    assert {(r.person_a, r.person_b) for r in alike_names(people(spark, rows)).collect()} == {("mal:3", "mal:4"), ("mal:7", "mal:8")}


def test_romaji(spark):
    rows = [("mal:1", None, "Miyazaki, Hayao"), ("anilist:1", None, "Hayao Miyazaki"), ("mal:2", None, "Jun'ichi Sato"), ("anilist:2", None, "SATO Junichi"), ("mal:3", None, "Ken Ito X"), ("mal:4", None, "Ito Ken X"), ("anilist:3", None, "Ken Ito X"), ("anilist:4", None, None)]
    assert {(r.person, r.canonical) for r in romaji_matches(people(spark, rows)).collect()} == {("anilist:1", "mal:1"), ("anilist:2", "mal:2")}
    assert spark.range(1).select(romaji_key(F.lit("B-a  C").cast("string")).alias("k")).first().k == "ba c"


def test_alike_texts_share_a_key():
    rng, alike = random.Random(4), 0
    for _ in range(6000):
        a = "abc" + "".join(rng.choice("adnorst") for _ in range(rng.randrange(4, 60)))
        b = a
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(3, len(b) + 1)
            b = b[:k] + rng.choice(["", "a", "o"]) + b[k + rng.randrange(2) :]
        if a != b and indel_ratio(a, b) >= 0.95:
            long, short = sorted((a, b), key=len, reverse=True)
            alike += 1
            assert set(alike_keys(long, 3)[0]) & set(alike_keys(short, 3)[1]), (a, b)
    assert alike > 500
    # unrelated texts of one head share none
    assert not set(alike_keys("abcdefghijklmnopqrstuv", 3)[0]) & set(alike_keys("abcvutsrqponmlkjihgfed", 3)[1])
