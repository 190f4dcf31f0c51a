"""Queries: event-time windows in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.streaming import events as E

from .registry import query, table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed(table(spark, sf_dir, "events"), "1 hour", by=("event_type",))


@query("SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER u + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"), "2 hours", ("user_id",))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(try_cast(json_extract_string(props, '$.k') AS INT)), 6) AS mean_k FROM events GROUP BY event_type")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg(k), 6).alias("mean_k"))
