"""Streams over the events table, run to its end, with SQL for the batch that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.streaming import streams as T

from .registry import Registry
from .relations import Relations

R = Registry()


@R.query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def stream_daily(r: Relations):
    s = T.events(r.spark, f"{r.sf_dir}/events.parquet")
    out = T.drained(T.windowed(s), "daily", "update", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


@R.query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(r: Relations):
    s = T.events(r.spark, f"{r.sf_dir}/events.parquet")
    return T.drained(T.deduplicated(s.select("event_id", "user_id", "event_type", "at"), ["event_id"], "400 days"), "dedup").select("event_id", "user_id", "event_type")


@R.query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(r: Relations):
    s = T.events(r.spark, f"{r.sf_dir}/events.parquet")
    out = T.drained(T.sessions(s), "sessions", mode="complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@R.query("""
SELECT date_trunc('day', ts) - to_days(k::INT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def stream_sliding(r: Relations):
    """Windows of two days, one beginning each day."""
    s = T.events(r.spark, f"{r.sf_dir}/events.parquet")
    out = T.drained(T.windowed(s, width="2 days", slide="1 day"), "sliding", "update", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


@R.query("""
WITH e AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN struct_pack(t := ts, i := event_id) END) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors,
       round(coalesce(sum(value) FILTER (last IS NULL OR struct_pack(t := ts, i := event_id) > last), 0), 4) AS since_purchase FROM e GROUP BY user_id""")
def stream_session_state(r: Relations):
    """Each person's running state after the last event."""
    s = T.events(r.spark, f"{r.sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "at")
    out = T.drained(T.session_state(s, "400 days"), "state", "update", ["user_id"])
    return out.withColumn("since_purchase", F.round("since_purchase", 4))


@R.query("SELECT user_id, arg_max(event_id, struct_pack(t := ts, i := event_id)) AS event_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS event_type FROM events GROUP BY user_id")
def stream_upsert(r: Relations):
    """Each person's newest event, kept by micro-batches."""
    from quarry.plans.cuts import new_path

    s = T.events(r.spark, f"{r.sf_dir}/events.parquet")
    path = new_path(r.spark, "newest")
    rows = s.select("user_id", F.struct("at", "event_id").alias("seen"), "event_id", "event_type")
    T.upsert(rows, path, ["user_id"], "seen").trigger(availableNow=True).start().awaitTermination()
    return T.upserted(r.spark, path).select("user_id", "event_id", "event_type")
