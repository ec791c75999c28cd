"""Windowed operators over ``events`` and embeddings search, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import events as ev

STEPS = ("view", "click", "purchase")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ev.sessions(table(spark, d, "events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = ev.gaps(table(spark, d, "events"))
    return g.groupBy("user_id").agg(F.count("gap").alias("n"), F.max("gap").alias("max_gap"), F.round(F.avg("gap"), 4).alias("mean_gap"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a field of the JSON column."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k.cast("long")).alias("total"), F.max(k).alias("most"))


def event_funnel(spark: SparkSession, d: str) -> DataFrame:
    return ev.funnel(table(spark, d, "events"), STEPS)


SQL = {
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sliding": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts) - o * INTERVAL '6 hours', '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY user_id",
    "event_gaps": "WITH g AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count(gap) AS n, max(gap) AS max_gap, round(avg(gap), 4) AS mean_gap FROM g GROUP BY user_id",
    "event_props": "SELECT event_type, count(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS most FROM events GROUP BY event_type",
    "event_funnel": "WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT e.user_id, min(ts) AS t FROM events e JOIN a ON a.user_id = e.user_id AND e.ts > a.t WHERE event_type = 'click' GROUP BY e.user_id), c AS (SELECT e.user_id, min(ts) AS t FROM events e JOIN b ON b.user_id = e.user_id AND e.ts > b.t WHERE event_type = 'purchase' GROUP BY e.user_id) SELECT 0 AS step, 'view' AS event_type, count(*) AS users FROM a UNION ALL SELECT 1, 'click', count(*) FROM b UNION ALL SELECT 2, 'purchase', count(*) FROM c",
}
QUERIES = {f.__name__: f for f in (event_windows, event_sliding, event_sessions, event_gaps, event_props, event_funnel)}
