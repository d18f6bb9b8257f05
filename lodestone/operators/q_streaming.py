"""Queries that run a stream over all available events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.registry import query
from lodestone.streaming import jobs, leases


@query("stream_hourly_metrics", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def stream_hourly_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run_through(jobs.hourly_metrics(jobs.read_events(spark, f"{sf}/events.parquet")))


@query("stream_lease_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_lease_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.run_through(jobs.lease_sessions(jobs.read_events(spark, f"{sf}/events.parquet")))


@query("lease", """WITH RECURSIVE w AS (SELECT user_id AS job, event_id, ts, event_type AS worker, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT job, i, event_id, ts, worker, 'claimed' AS outcome, worker AS holder, 1 AS token, ts + INTERVAL 6 HOUR AS until, 0 AS taken FROM w WHERE i = 1 UNION ALL
  SELECT job, i, event_id, ts, worker, outcome, CASE WHEN outcome = 'recovered' THEN worker ELSE holder END, CASE WHEN outcome = 'recovered' THEN token + 1 ELSE token END, CASE WHEN outcome IN ('recovered', 'renewed') THEN ts + INTERVAL 6 HOUR ELSE until END, CASE WHEN outcome = 'recovered' THEN taken + 1 ELSE taken END
  FROM (SELECT w.job, w.i, w.event_id, w.ts, w.worker, s.holder, s.token, s.until, s.taken, CASE WHEN s.outcome IN ('quarantined', 'refused') THEN 'refused' WHEN w.ts <= s.until THEN CASE WHEN w.worker = s.holder THEN 'renewed' ELSE 'fenced' END WHEN s.taken >= 3 THEN 'quarantined' ELSE 'recovered' END AS outcome
    FROM s JOIN w ON w.job = s.job AND w.i = s.i + 1))
SELECT job, event_id, worker, outcome, token, epoch_us(until) AS until FROM s""")
def lease(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as words on jobs, types as workers, six hours a lease (they come hours apart): what each word is told. Notices of leases that ran out depend on the
    watermark and are left out here."""
    events = jobs.read_events(spark, f"{sf}/events.parquet")
    words = events.select(F.col("user_id").alias("job"), "event_id", "ts", F.col("event_type").alias("worker"))
    out = leases.lease_outcomes(words, timedelta(hours=6)).where("event_id is not null")
    return jobs.run_appended(out.select("job", "event_id", "worker", "outcome", "token", F.unix_micros("lease_until").alias("until")))
