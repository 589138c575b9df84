"""Streams over events, read to the end of the present input; the batch query is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.sources import shared
from lectern.sources.sinks import RollUp
from lectern.streaming import streams


def _all_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event counts, however many batches and in whatever order their files come."""
    return streams.events(spark, folder, late=streams.span(spark, folder))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def stream_usage_daily(spark: SparkSession, folder: str) -> DataFrame:
    rows = streams.usage_by_day(_all_events(spark, folder)).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "calls", "value")
    return streams.drained(rows, "update", ["day", "event_type"])


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 DAY THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g),
    o AS (SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS writes, round(sum(value), 6) AS spent, max(ts) + INTERVAL 2 DAY AS closes FROM s GROUP BY user_id, n)
    SELECT user_id, start_us, writes, spent FROM o WHERE closes <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_session_spend(spark: SparkSession, folder: str) -> DataFrame:
    """Closed sessions only: those that ended two hours before the last event."""
    rows = streams.spending_sessions(_all_events(spark, folder))
    ends = streams.drained(rows.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "writes", "spent"), "complete")
    last = spark.read.parquet(f"{folder}/events.parquet").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))
    # one row: the time of the last event
    closed = ends.crossJoin(F.broadcast(last)).where(F.col("end_us") <= F.col("last_us") - 7_200_000_000)
    return closed.select("user_id", "start_us", "writes", "spent")


@query("""WITH s AS (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - k * 3600000000 AS start_us, event_type FROM events, range(0, 2) t(k))
    SELECT start_us, event_type, count(*) AS calls FROM s GROUP BY ALL""")
def stream_trailing_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = streams.trailing_rate(_all_events(spark, folder)).select(F.unix_micros("w.start").alias("start_us"), "event_type", "calls")
    return streams.drained(rows, "update", ["start_us", "event_type"])


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Messages delivered twice, kept once."""
    stream = _all_events(spark, folder)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.drained(streams.once(twice, "event_id").select("event_id", "user_id"))


@query("""WITH subs AS (SELECT c_custkey AS subscriber, c_custkey % 50 AS project FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT e.event_id, s.subscriber FROM events e JOIN subs s ON s.project = e.user_id WHERE event_type = 'error'""")
def stream_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Errors delivered to each subscriber of their project, a join of the stream with the table of subscriptions."""
    subs = spark.read.parquet(f"{folder}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subscriber"), (F.col("c_custkey") % 50).alias("user_id"))
    errors = streams.events(spark, folder).where("event_type = 'error'").select("event_id", "user_id", "ts")
    return streams.drained(errors.join(subs, "user_id").select("event_id", "subscriber"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, n, us + 172800000000 AS expires, false AS hit FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.n, CASE WHEN e.us < r.expires THEN r.expires ELSE e.us + 172800000000 END, e.us < r.expires FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS misses FROM r GROUP BY user_id""")
def stream_ttl_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache depends on the order of events, so all present files are one batch, sorted by time within a key."""
    return streams.drained(streams.cache_hits(streams.events(spark, folder, files_per_batch=None), 172_800), "update", ["user_id"])


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens
    FROM events GROUP BY ALL""")
def stream_usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sums that batches of the stream are added to exactly once: no watermark, no state, late events count."""
    rollup = RollUp(spark, shared.new_folder(spark, "usage-rollup"), {"day": "string", "event_type": "string"}, {"calls": "long", "tokens": "long"})
    rows = streams.events(spark, folder).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.lit(1).alias("calls"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    streams.added_to(rollup, rows)
    rollup.compact()
    return rollup.read()


@query("""WITH c AS (SELECT user_id, event_id % 20 AS subscriber, ts, event_id, event_type FROM events WHERE event_type IN ('signup', 'view')),
    d AS (SELECT m.event_id AS message_id, c.subscriber, arg_max(c.event_type, (c.ts, c.event_id)) AS kind FROM events m JOIN c ON c.user_id = m.user_id
        AND c.ts <= m.ts AND c.ts >= m.ts - INTERVAL 1 DAY WHERE m.event_type = 'error' GROUP BY m.event_id, c.subscriber)
    SELECT message_id, subscriber FROM d WHERE kind = 'signup'""")
def stream_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Errors delivered to those who are subscribed to their project then: signups subscribe for a day, views end it."""
    wanted = lambda *kinds: _all_events(spark, folder).where(F.col("event_type").isin(*kinds))
    messages = wanted("error").select(F.col("user_id").alias("project"), F.col("event_id").alias("message_id"), F.col("ts").alias("sent_at"))
    changes = wanted("signup", "view").select(
        F.col("user_id").alias("to"), (F.col("event_id") % 20).alias("subscriber"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"), F.col("event_type").alias("kind")
    )
    return streams.subscribed(streams.drained(streams.deliveries(messages, changes)), "signup")
