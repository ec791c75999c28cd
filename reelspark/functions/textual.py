"""Dates, names and differences of values as column expressions."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_date(c: Column) -> Column:
    """``YYYY-MM-DD`` with ``XX`` for unknown parts, from ISO, slash, dot, JSON and Japanese notations; null if no year is given."""
    part = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    y = F.coalesce(part(r'"year"\s*:\s*(\d{4})'), part(r"^\s*(\d{4})"))
    m = F.coalesce(part(r'"month"\s*:\s*(\d{1,2})'), part(r"^\s*\d{4}\s*[-/.年]\s*(\d{1,2})"))
    d = F.coalesce(part(r'"day"\s*:\s*(\d{1,2})'), part(r"^\s*\d{4}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*(\d{1,2})"))
    two = lambda x: F.coalesce(F.lpad(x, 2, "0"), F.lit("XX"))
    return F.when(y.isNotNull(), F.concat_ws("-", y, two(m), F.when(m.isNull(), "XX").otherwise(two(d))))


def date_precision(iso: Column) -> Column:
    """0 without a year, else 1 to 3 known parts."""
    return F.when(iso.isNull(), 0).otherwise(3 - F.regexp_count(iso, F.lit("XX")))


def dates_compatible(a: Column, b: Column) -> Column:
    """Parsed dates that agree in all parts both know."""
    same = lambda i: (F.split_part(a, F.lit("-"), F.lit(i)) == F.split_part(b, F.lit("-"), F.lit(i))) | (F.split_part(a, F.lit("-"), F.lit(i)) == "XX") | (F.split_part(b, F.lit("-"), F.lit(i)) == "XX")
    return F.coalesce(same(1) & same(2) & same(3), F.lit(False))


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility normal form."""
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return 2.0 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel_ratio`` of two columns; null with a null."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Texts of up to this length are met by parts.
LONGEST_CUT = 128


def _indels(m: int, n: int) -> int:
    """Letters left out and added at most between texts of these lengths with an indel ratio of 0.95; even if they are as long."""
    most = int(0.05 * (m + n) + 1e-9)
    return most - (most + m + n) % 2


@lru_cache(maxsize=4096)
def _cuts(m: int, head: int) -> list[tuple[int, int]]:
    """(start, length) of the parts a text of length ``m`` is cut into after its head, one more than it may have edits."""
    k, rest = int(0.1 * m + 1e-9) + 1, m - head
    return [(head + i * rest // k, (i + 1) * rest // k - i * rest // k) for i in range(k)]


@lru_cache(maxsize=4096)
def _spots(n: int, head: int) -> list[tuple[int, int, int, int]]:
    """(m, part, position, length) where a whole part of a text of length ``m`` may stand in one of length ``n``, not longer."""
    out, m = [], n
    while m <= LONGEST_CUT and m - n <= int(0.05 * (m + n) + 1e-9):
        most, gap = _indels(m, n), n - m
        for i, (p, k) in enumerate(_cuts(m, head)) if most else ():
            out += [(m, i, p + s, k) for s in range(-most, most + 1) if abs(s) + abs(gap - s) <= most and head <= p + s <= n - k]
        m += 1
    return out


def alike_keys(text: str, head: int) -> tuple[list[int], list[int]]:
    """(keys as the longer text, keys as the shorter): different texts of one head with an indel ratio of 0.95 share one."""
    n = len(text)
    if n > LONGEST_CUT or not 0.1 * n + 1e-9 >= 1:
        own = []
    else:
        own = [zlib.crc32(text[p : p + k].encode()) << 24 | n << 8 | i for i, (p, k) in enumerate(_cuts(n, head))]
    return own, list({zlib.crc32(text[at : at + k].encode()) << 24 | m << 8 | i for m, i, at, k in _spots(n, head)})


def difference_kind(a: Column, b: Column) -> Column:
    """How two values differ: null, identical, off_by_year, digit_count, single_char, multi_char or different."""
    n = r"^\d+$"
    numeric = a.rlike(n) & b.rlike(n)
    edits, longest = F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))
    return (
        F.when(a.isNull() | b.isNull(), "null").when(a == b, "identical")
        .when(numeric & (F.length(a) != F.length(b)), "digit_count")
        .when(numeric & (F.length(a) == 4) & (F.abs(F.try_to_number(a, F.lit("9999")) - F.try_to_number(b, F.lit("9999"))) == 1), "off_by_year")
        .when((edits == 1) & (longest > 3), "single_char").when(edits <= 0.3 * longest, "multi_char").otherwise("different")
    )


def canonical_id(ids: Column, prefix: str) -> Column:
    """A stable id of a set of ids: 12 hex digits of the digest of the sorted ids."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", F.sort_array(ids)), 256), 1, 12))


# Where a label names episodes, what else is numbered there, and the longest range read.
_EPISODES_IN = r"(?i)\(([^)]*\beps?\.?\s[^)]*)\)"
_NOT_EPISODES = r"(?i)(?:OP|ED|SP|OVA)\s*\d+"
_LONGEST_RANGE = 500


def parse_episodes(c: Column) -> Column:
    """Sorted distinct episode numbers of a label like ``Layout (eps 1-3, 5)``; empty without such a bracket."""
    text = F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), _EPISODES_IN, 1), _NOT_EPISODES, "")
    ranges = F.regexp_extract_all(text, F.lit(r"(\d+\s*[-–]\s*\d+)"), F.lit(1))
    ends = F.transform(ranges, lambda r: F.struct(F.regexp_extract(r, r"^(\d+)", 1).try_cast("int").alias("a"), F.regexp_extract(r, r"(\d+)$", 1).try_cast("int").alias("b")))
    good = F.filter(ends, lambda e: (e["b"] >= e["a"]) & (e["b"] - e["a"] <= _LONGEST_RANGE))
    spans = F.flatten(F.transform(good, lambda e: F.sequence(e["a"], e["b"])))
    single = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\d+\s*[-–]\s*\d+", ""), F.lit(r"(?<!\w)(\d+)(?!\w*[A-Za-z])"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(spans, single), lambda x: x.isNotNull())))
