"""Visually identical text with different characters (problem 7).

One form of a text that is the same for all texts a reader can't tell apart.
Method: removal of default-ignorable characters, compatibility normalisation in
composed form, whitespace mapped to single inner blanks, full case folding
where asked for, vectorised over the distinct values.  After it, look-alike
characters of any script are mapped to one of their kind by the Unicode
confusables table, which comes from the ICU library that Spark itself ships;
without that library the operator fails.

``fold_case`` is on by default in ``visual_forms`` users that compare loosely;
problem 7 states that letter case is a visible difference, so its query turns
it off.

Defined results: null stays null; an empty or blank text has the empty form,
which pairs with nothing; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Shelf

_IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]+")
_CONTROL = regex.compile(r"[^\P{Cc}\t\n\v\f\r\x1c-\x1f\x85]+")
_SPACE = regex.compile(r"[\s\p{Z}\x1c-\x1f⠀]+")
# Marks that look alike but that neither normalisation nor the table joins.
_EXTRA = {"〜": "~", "〰": "~", "∼": "~"}


def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Character to prototype, for every assigned character that has another one; its size is bounded by Unicode's."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker
    try:
        checker = checker.Builder().setChecks(checker.CONFUSABLE).build()
    except TypeError as e:  # a name py4j can't resolve stays a package
        raise RuntimeError("the look-alike table needs the ICU library of Spark's jars") from e
    chars = [chr(c) for c in range(0x21, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co", "Cc", "Cf", "Zs", "Zl", "Zp")]
    forms = checker.getSkeleton("\n".join(chars)).split("\n")
    if len(forms) != len(chars):
        raise RuntimeError("the look-alike table could not be read")
    return {c: f for c, f in zip(chars, forms, strict=True) if f != unicodedata.normalize("NFD", c)}


def visual_form(text: str, table: dict[int, str], fold_case: bool = False) -> str:
    """The consistent form of one text."""
    t = unicodedata.normalize("NFKC", _IGNORED.sub("", text))
    t = _CONTROL.sub("", _IGNORED.sub("", t))
    if fold_case:
        t = unicodedata.normalize("NFKC", t.casefold())
    t = _SPACE.sub(" ", t).strip(" ")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(table))


def visual_forms(values: DataFrame, column: str, fold_case: bool = False) -> DataFrame:
    """``values`` (distinct texts in ``column``) with ``form``."""
    spark = values.sparkSession
    found = lookalikes(spark)
    table = {ord(k): v for k, v in found.items() if len(unicodedata.normalize("NFD", k)) == 1} | {ord(k): v for k, v in _EXTRA.items()}
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = shared.value
        for s in batches:
            yield s.map(lambda x: None if x is None else visual_form(x, t, fold_case))

    return values.withColumn("form", form(column))


def lookalike_pairs(rows: DataFrame, fold_case: bool = False) -> DataFrame:
    """(table_name, id_a, id_b) of rows (table_name, id, text) whose texts differ but look the same."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("id").isNotNull()).select("table_name", "id", "text")
    shelf = Shelf(rows.sparkSession, "visual")
    texts = shelf.put(visual_forms(rows.select("table_name", "text").distinct(), "text", fold_case).filter(F.col("form") != ""), "texts")
    several = texts.groupBy("table_name", "form").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("table_name", "form")
    texts = shelf.put(texts.join(several, ["table_name", "form"], "left_semi"), "several")
    # distinct texts are paired first, so copies of one text never meet each other
    one, two = (texts.select("table_name", "form", F.col("text").alias(f"text_{x}")) for x in "xy")
    pairs = one.join(two, ["table_name", "form"]).filter("text_x < text_y").select("table_name", "text_x", "text_y")
    held = shelf.put(rows.join(texts.select("table_name", "text"), ["table_name", "text"], "left_semi").distinct(), "held")
    for x in "xy":
        pairs = pairs.join(held.select("table_name", F.col("text").alias(f"text_{x}"), F.col("id").alias(f"id_{x}")), ["table_name", f"text_{x}"])
    # an id may hold both texts
    return pairs.filter("id_x <> id_y").select("table_name", F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()


def visual_classes(rows: DataFrame, fold_case: bool = False) -> DataFrame:
    """(table_name, id, class_id): linear in the rows; class_id is the smallest id whose text has the same form; blank texts are left out."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("id").isNotNull()).select("table_name", "id", "text")
    shelf = Shelf(rows.sparkSession, "visual")
    texts = shelf.put(visual_forms(rows.select("table_name", "text").distinct(), "text", fold_case).filter(F.col("form") != ""), "texts")
    held = rows.join(texts, ["table_name", "text"])
    least = held.groupBy("table_name", "form").agg(F.min("id").alias("class_id"))
    return held.join(least, ["table_name", "form"]).select("table_name", "id", "class_id")
