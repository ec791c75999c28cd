"""Places shared by members against a plain count."""

from __future__ import annotations

import random

import pytest

from reelspark.operators import sharing
from reelspark.session import Shelf


@pytest.mark.parametrize("few", [0, 30, 1000])
def test_shared_places(spark, monkeypatch, few):
    monkeypatch.setattr(sharing, "FEW", few)  # all members as lists, some, or none
    monkeypatch.setattr(sharing, "AT_ONCE", 50)
    rng = random.Random(6)
    stays = sorted({(f"m{rng.randrange(9)}", 2000 + rng.randrange(12), f"p{rng.randrange(40):02d}") for _ in range(150)} | {("hub", 2000 + k % 15, f"p{k % 40:02d}") for k in range(60)})
    want = {}
    for a in sorted({s[2] for s in stays}):
        for b in sorted({s[2] for s in stays if s[2] > a}):
            both = {x[0] for x in stays for y in stays if x[0] == y[0] and x[2] == a and y[2] == b and abs(x[1] - y[1]) <= 2}
            if both:
                want[a, b] = len(both)
    got = sharing.shared_places(spark.createDataFrame(stays, "member string, year int, place string"), Shelf(spark, "t"))
    shuffled = got.collect()
    assert {(r.place_a, r.place_b): r.n for r in shuffled} == want and len(shuffled) == len(want)
