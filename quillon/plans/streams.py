"""Event-time windows over ``events``, run in batch so that another engine can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import pg
from quillon.plans.base import Lake
from quillon.plans.sqltext import SqlPlans
from quillon.streaming import events

plans = SqlPlans()
QUERIES, ORACLES = plans.queries, plans.oracles


@plans.query("q_tumbling", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def tumbling(spark, sf_dir):
    return events.tumbling(Lake(spark, sf_dir).events, "ts", "15 minutes", ["event_type"]).drop("total")


@plans.query("q_sliding", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * i AS start, event_type, count(*) AS n FROM events, range(3) r(i) WHERE ts IS NOT NULL GROUP BY ALL")
def sliding(spark, sf_dir):
    return events.sliding(Lake(spark, sf_dir).events, "ts", "30 minutes", "10 minutes", ["event_type"])


@plans.query(
    "q_sessions",
    """
    SELECT min(ts) AS start, user_id, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, session
    """,
)
def sessions(spark, sf_dir):
    return events.sessions(Lake(spark, sf_dir).events, "ts", "30 minutes", ["user_id"])


@plans.query("q_date_bin", "SELECT time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '2000-01-01') AS bin, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def date_bin(spark, sf_dir):
    rows = Lake(spark, sf_dir).events.filter("ts is not null")
    return rows.groupBy(pg.date_bin(420, "ts").alias("bin")).agg(F.count("*").alias("n"))


@plans.query(
    "q_debounce",
    """
    SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, burst
    """,
)
def debounce(spark, sf_dir):
    """The newest event of each burst of a user: the quiet window is 45 minutes"""
    return events.debounce(Lake(spark, sf_dir).events, "ts", "45 minutes", ["user_id"], "event_id")
