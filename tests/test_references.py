"""Orphan references on a small fixture."""

from __future__ import annotations

from datetime import datetime

from reelspark.operators.references import Child, Parent, orphan_groups, orphan_report


def ts(s):
    return datetime.fromisoformat(s) if s else None


def frames(spark, refs):
    child = spark.createDataFrame([(r, ts(t), "x") for r, t in refs], "ref string, at timestamp, table_name string")
    parent = spark.createDataFrame([("P:1", ts("2020-02-10"), 1), ("p:2", ts("2019-01-01"), 2), ("p:3", None, 3), (None, ts("2019-01-01"), 4)], "id string, at timestamp, ref_id int")
    red = spark.createDataFrame([("p:4", "p:2", "Parents"), ("p:7", None, "parents"), ("p:5", "p:6", "others")], "redirect_from_id string, redirect_to_id string, table_name string")
    return [Child("kids", child, "ref", "at", "parents")], [Parent("parents", parent, "id", "at")], red


REFS = [(" p:1", "2020-01-05"), ("P:1", "2020-01-06"), ("p:1", "2020-02-01"), ("p:1", "2020-02-11"), ("p:1", "2020-03-01"), ("p:2", "2020-01-01"), ("p:3", "2020-01-01"), ("p:4", "2020-01-01"), ("p:7", "2020-01-01"), ("p:5", "2020-01-01"), ("p:5", "2020-01-01"), (None, "2020-01-01"), ("  ", "2020-01-01"), ("p:9", None), ("p:1", None)]


def test_kinds(spark, rows):
    got = rows(orphan_groups(*frames(spark, REFS)).na.fill("?", ["ref_month"]), "ref_month", "ref_id", "orphan_kind")
    assert got == [("2020-01", "p:1", "late"), ("2020-01", "p:4", "redirected"), ("2020-01", "p:5", "absent"), ("2020-01", "p:7", "redirected"), ("2020-02", "p:1", "late"), ("?", "p:9", "absent")]


def test_report_counts_only_rows_before_the_parent(spark, rows):
    got = {(a, b): (n, k) for a, b, n, k in rows(orphan_report(*frames(spark, REFS)).na.fill("?", ["ref_month"]), "ref_month", "orphan_kind", "n_ids", "n_refs")}
    assert got == {("2020-01", "late"): (1, 2), ("2020-02", "late"): (1, 1), ("2020-01", "redirected"): (2, 2), ("2020-01", "absent"): (1, 2), ("?", "absent"): (1, 1)}


def test_empty(spark):
    assert orphan_groups(*frames(spark, [])).collect() == []
    assert orphan_report(*frames(spark, [])).collect() == []
