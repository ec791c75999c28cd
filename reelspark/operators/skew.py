"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
#: Below this many rows of one key a plain shuffle join is better.
HOT_ROWS = 200_000


def lookup_join(facts: DataFrame, total: int, lookup: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` to ``lookup`` (one row a key) on ``key``.

    ``weight`` is the column of ``lookup`` with the key's number of rows in
    ``facts``.  Keys above ``HOT_SHARE`` of ``total`` rows are at most 1000;
    they alone are broadcast and their facts stay where they are.  All other
    keys take the shuffle join.  ``weight`` isn't in the result.
    """
    at_least = max(HOT_ROWS, int(total * HOT_SHARE))
    if total < HOT_ROWS:
        return facts.join(lookup.drop(weight), key, how)
    hot = lookup.filter(F.col(weight) > at_least).drop(weight)
    if hot.isEmpty():
        return facts.join(lookup.drop(weight), key, how)
    keys = F.broadcast(hot.select(key))
    cold = facts.join(keys, key, "left_anti").join(lookup.filter(F.col(weight) <= at_least).drop(weight), key, how)
    return cold.unionByName(facts.join(F.broadcast(hot), key, "inner"))
