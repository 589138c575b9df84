"""Streams in several batches: late events, repeated messages, state across batches."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from lectern.plans import catalog
from lectern.streaming import streams
from tests.compare import connection, rows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


@pytest.fixture
def folder(spark, tmp_path):
    """Three files, read one a batch; event 3 comes long after the watermark has passed it and event 1 comes twice."""
    batches = [
        [(1, at(0), 7, "click", 1.0, None), (2, at(10), 7, "click", 2.0, None)],
        [(1, at(10.5), 7, "click", 1.0, None)],
        [(3, at(1), 7, "click", 4.0, None), (4, at(60), 7, "click", 8.0, None), (5, at(61), 8, "view", 1.0, None)],
    ]
    target = tmp_path / "events.parquet"
    os.makedirs(target)
    for n, rows in enumerate(batches):
        part = str(tmp_path / f"part{n}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(f"{part}/{name}", target / f"{n}.parquet")
        os.utime(target / f"{n}.parquet", (time.time() + n, time.time() + n))
    return str(tmp_path)


def test_late_events_are_left_out(spark, folder):
    stream = streams.events(spark, folder, files_per_batch=1)
    hours = stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.sum("value").alias("v")).select(F.hour("w.start").alias("h"), "v")
    got = {(r.h, r.v) for r in streams.drained(hours).collect()}
    assert (0, 1.0) in got and (10, 3.0) in got and not any(h == 1 for h, _ in got)
    batch = spark.read.parquet(f"{folder}/events.parquet")
    assert batch.where("event_id = 3").count() == 1


def test_repeats_within_the_watermark(spark, folder):
    stream = streams.events(spark, folder, late="20 hours", files_per_batch=1)
    got = sorted(r.event_id for r in streams.drained(streams.once(stream, "event_id").select("event_id")).collect())
    assert got == [1, 2, 3, 4, 5]


def test_cache_state_spans_batches(spark, folder):
    hits = streams.cache_hits(streams.events(spark, folder, late="20 hours", files_per_batch=1), 24 * 3600)
    got = {r.user_id: (r.hits, r.misses) for r in streams.drained(hits, "update", ["user_id"]).collect()}
    assert got == {7: (3, 2), 8: (0, 1)}


def test_sessions_close(spark, folder):
    sessions = streams.spending_sessions(streams.events(spark, folder, late="1 hour", files_per_batch=1), "12 hours")
    got = {(r.user_id, r.writes, r.spent) for r in streams.drained(sessions.select("user_id", "writes", "spent")).collect()}
    assert (7, 4, 8.0) in got  # a session is open for late events until its gap has passed


STREAMS = ("stream_usage_daily", "stream_session_spend", "stream_trailing_rate", "stream_dedup", "stream_ttl_cache", "stream_usage_rollup", "stream_deliveries")


@pytest.mark.parametrize("name", STREAMS)
def test_all_events_count_in_whatever_order_files_come(spark, tmp_path, monkeypatch, name):
    """Six files over mixed spans of time, a file a batch, against the SQL."""
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 1)
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    os.makedirs(tmp_path / "events.parquet")
    for n, k in enumerate((3, 5, 0, 4, 1, 2)):
        part = str(tmp_path / f"part{n}")
        days = F.floor(F.dayofyear("ts") / 5)
        table.where(F.pmod(days, F.lit(6)) == k).coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(f"{part}/{file}", tmp_path / "events.parquet" / f"{n}.parquet")
        os.utime(tmp_path / "events.parquet" / f"{n}.parquet", (time.time() + n, time.time() + n))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = connection("/root/testdata/sf0.001").sql(catalog.ORACLE[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
