"""Match groups against union-find."""

from __future__ import annotations

import random

from reelspark.llm import groups

SCHEMA = "redirect_from_id string, redirect_to_id string, table_name string, group_id int"


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, t, *_ in pairs:
        if not t or not t.strip() or not a or not b:
            continue
        t, a, b = t.strip().lower(), a.strip().lower(), b.strip().lower()
        if a and b and a != b:
            x, y = find((t, a)), find((t, b))
            parent[max(x, y)] = min(x, y)
    out = []
    for k in parent:
        out.append((k[0], find(k)[1], k[1]))
    return sorted(out)


def run(spark, data):
    df = spark.createDataFrame([(*r, 1) for r in data], SCHEMA)
    return sorted(map(tuple, groups.match_groups(df, "redirect_from_id", "redirect_to_id", "table_name").collect()))


def test_chains_hubs_and_random(spark):
    rng = random.Random(3)
    chain = [(f"x:{i:03d}", f"x:{i + 1:03d}", "anime") for i in range(40)]
    hub = [("h:0", f"h:{i}", "persons") for i in range(1, 60)]
    noise = [(f"r:{rng.randrange(120)}", f"r:{rng.randrange(120)}", rng.choice(["anime", "studios"])) for _ in range(90)]
    data = chain + hub + noise + chain[:5]
    rng.shuffle(data)
    assert run(spark, data) == brute(data)


def test_nulls_blanks_self_links_and_scopes(spark):
    data = [(" A:1", "a:2 ", "Anime"), ("a:2", "a:2", "anime"), ("a:9", "A:9", "anime"), (None, "a:3", "anime"), ("a:4", " ", "anime"), ("a:5", "a:6", None), ("a:1", "b:7", "persons")]
    assert run(spark, data) == [("anime", "a:1", "a:1"), ("anime", "a:1", "a:2"), ("persons", "a:1", "a:1"), ("persons", "a:1", "b:7")]


def test_empty(spark):
    assert run(spark, []) == []
