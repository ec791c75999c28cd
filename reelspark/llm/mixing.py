"""Mixing sources to target weights (problem 9).

Each source gets ``share * total`` tokens: every one of its documents has the
same expected number of copies, ``share * total / available``, at most the
source's cap.  Method: systematic sampling.  The documents' expected copies are
prefix-summed within the source, one random offset per source is added, and a
document is emitted once per integer boundary its interval crosses; so no
document exceeds the cap and the number of copies is exact to one.

The prefix sum has no window over a whole source: documents fall into buckets
by a seeded hash of their id, bucket counts give each bucket's start, and only
within a bucket rows are ordered (by size, so that long and short documents
are drawn evenly, then by hash).  Buckets grow with the rows, not in size.

Defined results: labels are compared trimmed, in lower case, ``-`` read as
``_``; null labels and unlisted sources are left out; a null or empty text has
0 tokens and is drawn like any other; a listed source without documents has
share 0; a null target share or cap counts as 0.  What a source with too few
documents can't give is reported as its shortfall; the others keep their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_label
from ..session import Shelf
from .tokens import encode_documents

#: Documents a bucket holds on average.
BUCKET_ROWS = 200_000


def _uniform(seed: int, *cols: str):  # noqa: ANN202
    """A number in [0, 1) from a stable hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), 11).cast("double") * F.lit(2.0**-53)


def plan_mix(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per listed source: target_share, max_repeats, n_docs, available tokens and rate (expected copies of a document)."""
    t = targets.select(clean_label("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    t = t.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens").cast("long")).alias("available"))
    plan = t.join(have, "source", "left").fillna(0, ["n_docs", "available"])
    whole = F.lit(total) if total is not None else F.sum("available").over(Window.partitionBy(F.lit(1)))  # one row a listed source
    plan = plan.withColumn("wanted", F.col("target_share") * whole)
    return plan.withColumn("rate", F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("available"))).otherwise(0.0))


def systematic_copies(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, copies of the documents drawn at least once."""
    n = sized.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    rows = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sizes = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(plan.select("source", "rate"), "source")
    own = Window.partitionBy("source", "bucket").orderBy("n_tokens", "h", "doc_id")
    rows = rows.withColumn("i", F.row_number().over(own)).join(starts, ["source", "bucket"])
    rank = F.col("start") + F.col("i")
    u = _uniform(seed, "source")
    copies = F.floor(rank * F.col("rate") + u) - F.floor((rank - 1) * F.col("rate") + u)
    return rows.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).filter(F.col("copies") > 0)


def sized_documents(docs: DataFrame, targets: DataFrame, shelf: Shelf) -> DataFrame:
    """doc_id, source, n_tokens of the documents of listed sources, encoded once."""
    listed = targets.select(clean_label("source").alias("source")).distinct()
    rows = docs.select("doc_id", clean_label("source").alias("source"), "text").join(listed, "source", "left_semi")
    return shelf.put(encode_documents(rows, ["doc_id", "source"], counts_only=True), "sized")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, copy_no, n_tokens: the mixture, one row per emitted copy."""
    shelf = Shelf(docs.sparkSession, "mix")
    sized = sized_documents(docs, targets, shelf)
    drawn = systematic_copies(sized, plan_mix(sized, targets, total), seed)
    return drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens")


def mix_shares(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """Per listed source: target and actual share, documents, tokens, the most copies of a document, and the tokens its cap keeps it short of the target."""
    shelf = Shelf(docs.sparkSession, "mix")
    sized = sized_documents(docs, targets, shelf)
    plan = plan_mix(sized, targets, total)
    got = systematic_copies(sized, plan, seed).groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("n_tokens").cast("long")).alias("tokens"), F.max("copies").alias("most_copies"))
    out = plan.join(got, "source", "left").fillna(0, ["docs_used", "rows", "tokens", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return out.select("source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"), "max_repeats", "most_copies", "n_docs", "docs_used", "rows", "tokens", "available", F.greatest(F.lit(0), F.round(F.col("wanted")).cast("long") - F.col("tokens")).alias("shortfall"))
