"""References to rows that do not exist, or came later (problem 6).

Method: parent keys, redirects and pre-aggregated child keys go in long form
into one shuffle on (parent table, key); a group without a parent row is an
orphan, a group whose parent came after the referring row is late.  Children
are first reduced to one row a (child table, key, month), so a key that holds
a third of all rows reaches the shuffle as one row a month and map task.

Null and blank references are no references.  A referring row without a
timestamp has a null month and can't be late.  A parent row without a
timestamp exists but is never late.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id


@dataclass(frozen=True)
class Child:
    """A referring table: its name, frame, reference column, timestamp column and the parent table's name."""

    name: str
    frame: DataFrame
    ref: str
    at: str
    parent: str


@dataclass(frozen=True)
class Parent:
    """A referred-to table: its name, frame, key column and timestamp column."""

    name: str
    frame: DataFrame
    key: str
    at: str


_NONE = "cast(null as string)"


def _children(children: Sequence[Child]) -> DataFrame:
    out = None
    for c in children:
        part = (
            c.frame.select(clean_id(c.ref).alias("ref_id"), F.col(c.at).alias("ts"))
            .filter(F.col("ref_id").isNotNull())
            .groupBy("ref_id", F.date_format("ts", "yyyy-MM").alias("ref_month"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"))
            .select(F.lit(c.parent).alias("parent"), "ref_id", F.lit(c.name).alias("table_name"), "ref_month", "first_ts", "last_ts", "n_rows")
        )
        out = part if out is None else out.unionByName(part)
    assert out is not None, "at least one child table is needed"
    return out


def orphan_groups(children: Sequence[Child], parents: Sequence[Parent], redirects: DataFrame) -> DataFrame:
    """One row per orphan (table_name, ref_month, ref_id): its kind, counts and the parent's time.

    ``redirects`` has table_name, redirect_from_id, redirect_to_id.  ``n_rows``
    counts the referring rows of the month; of a ``late`` one some may have come
    after the parent: see ``orphan_report`` for exact counts.
    """
    kids = _children(children)
    empty = {"table_name": "string", "ref_month": "string", "first_ts": "timestamp_ntz", "last_ts": "timestamp_ntz", "n_rows": "bigint"}
    kind = dict(kids.dtypes)
    nulls = {k: F.lit(None).cast(kind.get(k, v)) for k, v in empty.items()}
    rows = kids.withColumns({"parent_ts": F.lit(None).cast(kind["first_ts"]), "is_parent": F.lit(False), "is_redirect": F.lit(False)})
    for p in parents:
        own = p.frame.select(clean_id(p.key).alias("ref_id"), F.col(p.at).cast(kind["first_ts"]).alias("parent_ts")).filter(F.col("ref_id").isNotNull())
        rows = rows.unionByName(own.select(F.lit(p.name).alias("parent"), "ref_id", *[v.alias(k) for k, v in nulls.items()], "parent_ts", F.lit(True).alias("is_parent"), F.lit(False).alias("is_redirect")))
    sides = redirects.select(
        clean_id("table_name").alias("parent"),
        F.explode(F.array(clean_id("redirect_from_id"), clean_id("redirect_to_id"))).alias("ref_id"),
    ).filter(F.col("ref_id").isNotNull() & F.col("parent").isNotNull()).distinct()
    rows = rows.unionByName(sides.select("parent", "ref_id", *[v.alias(k) for k, v in nulls.items()], F.lit(None).cast(kind["first_ts"]).alias("parent_ts"), F.lit(False).alias("is_parent"), F.lit(True).alias("is_redirect")))
    child = F.struct("table_name", "ref_month", "first_ts", "last_ts", "n_rows")
    # a group's list has at most one entry a child table and month
    grouped = rows.groupBy("parent", "ref_id").agg(
        F.max("parent_ts").alias("parent_ts"),
        F.max("is_parent").alias("is_parent"),
        F.max("is_redirect").alias("is_redirect"),
        F.min(F.col("first_ts")).alias("first_seen"),
        F.collect_list(F.when(F.col("table_name").isNotNull(), child)).alias("kids"),
    )
    grouped = grouped.filter((F.size("kids") > 0) & (~F.col("is_parent") | (F.col("parent_ts") > F.col("first_seen"))))
    one = grouped.select("ref_id", "parent_ts", "is_parent", "is_redirect", F.explode("kids").alias("k")).select("k.*", "ref_id", "parent_ts", "is_parent", "is_redirect")
    how = F.when(~F.col("is_parent"), F.when(F.col("is_redirect"), "redirected").otherwise("absent")).when(F.col("parent_ts") > F.col("first_ts"), "late")
    return one.withColumn("orphan_kind", how).filter(F.col("orphan_kind").isNotNull()).drop("is_parent", "is_redirect")


def orphan_report(children: Sequence[Child], parents: Sequence[Parent], redirects: DataFrame) -> DataFrame:
    """Orphan ids and referring rows by (table_name, ref_month, orphan_kind).

    For months wholly before the parent the pre-aggregated count holds; only
    the month in which the parent arrived is counted row by row.
    """
    found = orphan_groups(children, parents, redirects)
    split = (F.col("orphan_kind") == "late") & (F.col("last_ts") >= F.col("parent_ts"))
    whole = found.filter(~split).select("table_name", "ref_month", "orphan_kind", "ref_id", "n_rows")
    border = found.filter(split).select("table_name", "ref_month", "ref_id", "parent_ts")
    exact = None
    for c in children:
        part = (
            c.frame.select(clean_id(c.ref).alias("ref_id"), F.col(c.at).alias("ts"))
            .withColumn("ref_month", F.date_format("ts", "yyyy-MM"))
            .join(border.filter(F.col("table_name") == c.name), ["ref_id", "ref_month"])
            .filter(F.col("ts") < F.col("parent_ts"))
            .groupBy("table_name", "ref_month", "ref_id")
            .agg(F.count("*").alias("n_rows"))
            .select("table_name", "ref_month", F.lit("late").alias("orphan_kind"), "ref_id", "n_rows")
        )
        exact = part if exact is None else exact.unionByName(part)
    return whole.unionByName(exact).groupBy("table_name", "ref_month", "orphan_kind").agg(F.count("*").alias("n_ids"), F.sum("n_rows").alias("n_refs"))
