"""Stores, streams and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.textual import canonical_id, date_precision, dates_compatible, difference_kind, indel, indel_ratio, nfkc, parse_date, parse_episodes
from reelspark.sources import store
from reelspark.streaming import events as ev


def test_drifting_partitions(spark, tmp_path, rows):
    root = str(tmp_path / "raw")
    a = spark.createDataFrame([("1", 5, "s1", "t", "2024-01-01")], "id string, n int, source string, table string, date string")
    b = spark.createDataFrame([("1", "new", "s1", "t", "2024-01-02")], "id string, title string, source string, table string, date string")
    store.append_partitions(a, root)
    store.append_partitions(b, root)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("title", T.StringType()), T.StructField("gone", T.DoubleType())])
    got = store.read_partitions(spark, root, "t", schema)
    assert got.columns == ["id", "n", "title", "gone", "source", "date"]
    assert [tuple(r)[:4] for r in got.orderBy("date").collect()] == [("1", 5, None, None), ("1", None, "new", None)]
    assert rows(store.latest(got, ["id"], ["date"]), "id", "title", "date") == [("1", "new", "2024-01-02")]


def test_upserts(spark, rows):
    old = spark.createDataFrame([("a", 1, ""), ("b", 2, "x")], "k string, v int, t string")
    new = spark.createDataFrame([("b", 9, "y"), ("c", 3, "z"), ("c", 3, "z")], "k string, v int, t string")
    assert rows(store.insert_ignore(old, new, ["k"])) == [("a", 1, ""), ("b", 2, "x"), ("c", 3, "z")]
    assert rows(store.upsert(old, new, ["k"])) == [("a", 1, ""), ("b", 9, "y"), ("c", 3, "z")]
    fill = spark.createDataFrame([("a", 0, "f"), ("b", 0, "g")], "k string, v int, t string")
    assert rows(store.update_from(old, fill, ["k"], ["t"])) == [("a", 1, "f"), ("b", 2, "x")]
    assert rows(store.update_from(old, fill, ["k"], ["t"], only_empty=False)) == [("a", 1, "f"), ("b", 2, "g")]
    assert rows(store.delete_in(old, new, ["k"])) == [("a", 1, "")]
    o, n = (spark.createDataFrame(x, "k string, h string") for x in ([("a", "1"), ("b", None), ("c", "3")], [("a", "2"), ("b", "2"), ("c", "3"), ("d", None)]))
    assert rows(store.changed_rows(o, n, ["k"], "h"), "k") == [("a",), ("d",)]


def test_replace_and_compact(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.range(20).withColumn("v", F.col("id") % 3)
    store.replace(df.repartition(6), path)
    store.replace(df.unionByName(df).repartition(6), path)
    assert store.compact(spark, path, 1000, distinct=True) == 20 and store.compact(spark, path) == 20
    assert len(list((tmp_path / "t").glob("part-*"))) == 1
    back = spark.read.parquet(path)
    assert store.digest(back) == store.digest(df.orderBy(F.desc("id"))) != store.digest(df.limit(19))


def test_formats(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        w = df.write.option("header", True) if kind == "csv" else df.write
        w.format(kind).save(str(tmp_path / kind))
        back = store.read_any(spark, str(tmp_path / kind), "jsonl" if kind == "json" else kind, "n int, s string")
        assert sorted((r.n, r.s) for r in back.collect() if r.s) == [(1, "a")] and back.count() == 2


def test_votes(spark, rows):
    df = spark.createDataFrame([("k", "a", "s2"), ("k", "b", "s1"), ("k", "a", "s3"), ("j", None, "s1"), ("j", "z", "s9")], "k string, v string, s string")
    assert rows(store.majority(df, "k", "v")) == [("j", "z"), ("k", "a")]
    assert rows(store.first_by_rank(df, "k", {"s1": 1, "s2": 2}, "s", "v")) == [("j", "z"), ("k", "b")]


def test_text_functions(spark):
    raw = ["2020-1-2", "2020/03", "2019年4月5日", '{"year": 2018, "month": 7, "day": null}', "2011-01-XX", "soon", None, "2009"]
    df = spark.createDataFrame([(r,) for r in raw], "d string").select(parse_date(F.col("d")).alias("i"))
    df = df.select("i", date_precision(F.col("i")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [("2020-01-02", 3), ("2020-03-XX", 2), ("2019-04-05", 3), ("2018-07-XX", 2), ("2011-01-XX", 2), (None, 0), (None, 0), ("2009-XX-XX", 1)]
    pair = spark.createDataFrame([("2020-XX-XX", "2020-01-02"), ("2020-02-XX", "2020-01-02"), (None, "2020-01-02")], "a string, b string")
    assert [r[0] for r in pair.select(dates_compatible(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    kinds = [("1999", "2000", "off_by_year"), ("12", "120", "digit_count"), ("abcde", "abxde", "single_char"), ("abcdefghij", "abcdefgxyj", "multi_char"), ("a", "b", "different"), ("a", "a", "identical"), (None, "a", "null")]
    got = spark.createDataFrame(kinds, "a string, b string, k string").select(difference_kind(F.col("a"), F.col("b")).alias("g"), "k").collect()
    assert all(r.g == r.k for r in got)
    assert indel_ratio("abcd", "abxd") == 0.75 and indel_ratio("", "") == 1.0
    one = spark.createDataFrame([("ＡＢ", "AB"), (None, "x")], "a string, b string").select(nfkc("a").alias("n"), indel(nfkc("a"), F.col("b")).alias("r"), canonical_id(F.array(F.lit("b"), F.lit("a")), "x:").alias("c")).collect()
    assert one[0].n == "AB" and one[0].r == 1.0 and one[1].r is None and len(one[0].c) == 14


def test_episodes(spark):
    raw = [("Layout (eps 1-3, 5)", [1, 2, 3, 5]), ("Director (ep. 2)", [2]), ("x (OP24, eps 903, 1000)", [903, 1000]), ("y (eps 9-7, 8)", [8]), ("z (ep 1-9999)", []), (None, []), ("", [])]
    raw += [("2nd Key Animation", []), ("CGI Director 12345", []), ("(ep 3a, 4)", [4]), ("(ep 99999999999)", [])]
    df = spark.createDataFrame(raw, "t string, want array<int>").select(parse_episodes(F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_streams_equal_batches(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    src = tmp_path / "in"
    batch.repartitionByRange(3, "ts").write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    for name, f, keys in (("w", ev.tumbling, 4), ("s", ev.sliding, 2), ("u", ev.sessions, 4)):
        q = f(stream, late="60 days").writeStream.outputMode("complete" if name != "u" else "append").format("memory").queryName(f"out_{name}").start()
        q.processAllAvailable()
        q.stop()
        if name != "u":  # sessions stay open until the watermark passes them
            assert sorted(map(tuple, spark.table(f"out_{name}").collect())) == sorted(map(tuple, f(batch).collect()))
    q = ev.drift(stream, 20.0, 1.0, 50.0).writeStream.outputMode("update").format("memory").queryName("out_d").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.key: r.n for r in spark.table("out_d").groupBy("key").agg(F.max("n").alias("n")).collect()}
    assert last == {r.event_type: r.n for r in batch.groupBy("event_type").agg(F.count("value").alias("n")).collect()}
