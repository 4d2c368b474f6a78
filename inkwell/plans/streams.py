"""Batch twins of the stream operators: the same aggregation over the whole table, with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.plans.history import DECISIONS, SCANS, decisions, scans, stamp
from inkwell.registry import query, table
from inkwell.streaming import streams as X


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: stamp(c) for c in ("start", "end") if c in df.columns})


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Events as link results."""
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"), F.floor("value").alias("response_ms"))


@query("x2_live_link_stats", """SELECT strftime(time_bucket(INTERVAL 1 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS "start", strftime(time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", event_type AS status, count(*) AS links, min(floor(value))::BIGINT AS fastest, avg(floor(value)::BIGINT) AS mean, max(floor(value))::BIGINT AS slowest FROM events GROUP BY ALL""")
def live_link_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(X.live_link_stats(results(spark, sf)))


@query("x4_stream_activity", f"""WITH {SCANS} SELECT strftime(time_bucket(INTERVAL 1 HOUR, scan_time), '%Y-%m-%d %H:%M:%S') AS "start", strftime(time_bucket(INTERVAL 1 HOUR, scan_time) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS scans, avg(score) AS score FROM scans GROUP BY ALL""")
def activity(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(X.activity(scans(spark, sf)))


@query("x8_sliding_quality", f"""WITH {SCANS}, d AS (SELECT scan_time::DATE - i AS s, category, score FROM scans, range(7) r(i)) SELECT strftime(s::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s::TIMESTAMP + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS "end", category, count(*) AS scans, avg(score) AS score FROM (SELECT (s)::DATE AS s, category, score FROM d) GROUP BY ALL""".replace("scan_time::DATE - i AS s", "scan_time::DATE - i::INTEGER AS s"))
def sliding_quality(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(X.sliding_quality(scans(spark, sf)))


@query("x3_stream_batches", f"""WITH {SCANS}, g AS (SELECT *, CASE WHEN epoch_us(scan_time) - lag(epoch_us(scan_time)) OVER (PARTITION BY category ORDER BY scan_time, scan_id) < 30000000 THEN 0 ELSE 1 END AS apart FROM scans), b AS (SELECT *, sum(apart) OVER (PARTITION BY category ORDER BY scan_time, scan_id) AS burst FROM g) SELECT strftime(min(scan_time), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(scan_time) + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS "end", category, count(*) AS scans, avg(score) AS score FROM b GROUP BY category, burst""")
def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(X.bursts(scans(spark, sf), ["category"]))


@query("x5_stream_learning", f"WITH {DECISIONS} SELECT pattern_key, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'edited') AS edited, count(*) AS total FROM decisions GROUP BY 1")
def stream_learning(spark: SparkSession, sf: str) -> DataFrame:
    return X.learning(decisions(spark, sf))


@query("x7_batch_progress", """SELECT user_id AS batch, count(*) AS done, count(*) FILTER (event_type = 'error') AS failed, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "first", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "last" FROM events GROUP BY 1""")
def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return X.progress(e).withColumns({c: stamp(c) for c in ("first", "last")})
