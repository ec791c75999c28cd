"""Reading and writing tables: drifting partitions, upserts, atomic replacement, compaction and a manifest of inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast where present, typed nulls where absent."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_partitions(spark: SparkSession, root: str, table: str, schema: T.StructType, source: str = "*") -> DataFrame:
    """All days of a raw table under ``source=/table=/date=``, with ``source`` and ``date``; columns may differ by source and day."""
    raw = spark.read.option("mergeSchema", True).option("basePath", root).parquet(f"{root}/source={source}/table={table}")
    full = T.StructType([*schema.fields, T.StructField("source", T.StringType()), T.StructField("date", T.StringType())])
    return conform(raw, full)


def append_partitions(df: DataFrame, root: str) -> None:
    """Append rows that have ``source``, ``table`` and ``date`` to the raw layout."""
    df.write.mode("append").option("compression", "zstd").partitionBy("source", "table", "date").parquet(root)


def read_any(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Files of a kind Spark reads (parquet, orc, json, jsonl, csv, text), or ``jdbc``."""
    kind, extra = ("json", {}) if kind == "jsonl" else ("json", {"multiLine": "true"}) if kind == "json" else (kind, {"header": "true"} if kind == "csv" else {})
    reader = spark.read.format(kind).options(**extra, **options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load() if kind == "jdbc" else reader.load(path)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; ties are settled by all other columns."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = F.max(F.struct(*order, F.xxhash64(*rest).alias("__tie") if rest else F.lit(0).alias("__tie"), *rest)).alias("m")
    return df.groupBy(*keys).agg(best).select(*[F.col(k) if k in keys else F.col(f"m.{k}").alias(k) for k in df.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows win: new rows are added for unknown keys, one a key."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def update_from(old: DataFrame, other: DataFrame, keys: list[str], columns: list[str], only_empty: bool = True) -> DataFrame:
    """``old`` with ``columns`` taken from ``other`` (one row a key); by default only where null or blank."""
    side = other.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = old.join(side, keys, "left")
    for c in columns:
        mine = F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull() if only_empty else F.lit(True)
        out = out.withColumn(c, F.when(mine & F.col(f"__{c}").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*old.columns)


def delete_in(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """New rows whose digest is known and differs from a known old one, or whose key is new; an unknown digest never refreshes."""
    x = new.join(old.select(*keys, F.col(digest).alias("__old"), F.lit(True).alias("__has")), keys, "left")
    return x.filter(F.col("__has").isNull() | (F.col(digest) != F.col("__old"))).drop("__old", "__has")


def replace(df: DataFrame, path: str) -> None:
    """Replace a table's folder whole: readers see the old or the new one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tag = uuid.uuid4().hex[:8]
    fresh, stale = f"{path}.new-{tag}", f"{path}.old-{tag}"
    df.write.parquet(fresh)
    if fs.exists(make(path)):
        fs.rename(make(path), make(stale))
    if not fs.rename(make(fresh), make(path)):
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(make(stale), True)


def compact(spark: SparkSession, path: str, rows_per_file: int = 5_000_000, distinct: bool = False) -> int:
    """Rewrite a folder of small files into few ones, optionally without repeated rows; returns the rows kept."""
    df = spark.read.parquet(path)
    before = df.count()
    out = df.distinct() if distinct else df
    replace(out.repartition(max(1, -(-before // rows_per_file))), path)
    after = spark.read.parquet(path).count()
    if not distinct and after != before:
        raise OSError(f"{path}: {before} rows became {after}")
    return after


def digest(df: DataFrame) -> str:
    """A digest of a frame's rows in any order, for skipping work on unchanged input."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), *cols)).alias("x")).first()
    return f"{row['n']}-{row['s']}-{row['x']}"


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value of each key; ties go to the smaller one."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def first_by_rank(df: DataFrame, key: str, ranks: dict[str, int], source: str, value: str) -> DataFrame:
    """(key, value): the value of the best ranked source; unknown sources last, ties by value."""
    rank = F.coalesce(*[F.when(F.col(source) == k, F.lit(v)) for k, v in ranks.items()], F.lit(1 << 30))
    w = Window.partitionBy(key).orderBy(rank, value)
    return df.filter(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(w)).filter("__k = 1").select(key, value)
