"""Event streams: sources, windowed and stateful operators, and sinks that end when all input is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.sources import shared
from lectern.sources.sinks import RollUp


#: Files of a batch, unless told otherwise.
FILES_PER_BATCH = 1000


def span(spark: SparkSession, folder: str) -> str:
    """How far the event table's times reach: with this lateness no event of it is late, in whatever order its files come."""
    ts = F.col("ts").cast("timestamp")
    first, last = spark.read.parquet(f"{folder}/events.parquet").agg(F.unix_seconds(F.min(ts)), F.unix_seconds(F.max(ts))).first()
    return f"{(last or 0) - (first or 0) + 3600} seconds"


def events(spark: SparkSession, folder: str, late: str = "2 hours", files_per_batch: int | None = 0) -> DataFrame:
    """The event table as a stream by event time; events later than ``late`` may be left out of windows.

    ``files_per_batch`` None makes all present files one batch, for operators that need their events in time order.
    """
    files_per_batch = FILES_PER_BATCH if files_per_batch == 0 else files_per_batch
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, as the stream source takes a plain path for a folder; it matches the one file or folder
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path.removesuffix("t") + "[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def drained(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """All output of ``stream`` after its present input, as a table.

    Appended rows go to Parquet as they are. In update mode each batch is written under its number, and the latest row of each
    ``key`` is the result. In complete mode each batch replaces the one before.
    """
    spark, path = stream.sparkSession, shared.new_folder(stream.sparkSession, "stream")
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    if mode == "complete":
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).outputMode(mode)
        query.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    rest = [c for c in stream.columns if c not in key]
    last = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("v"))
    return last.select(*key, "v.*")


def added_to(rollup: RollUp, stream: DataFrame) -> None:
    """Adds the present input of ``stream`` to ``rollup``; what earlier runs have read is not read again."""
    query = stream.writeStream.foreachBatch(rollup.add).option("checkpointLocation", f"{rollup.folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def usage_by_day(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 6).alias("value"))


def spending_sessions(stream: DataFrame, gap: str = "2 days") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("writes"), F.round(F.sum("value"), 6).alias("spent"))


def trailing_rate(stream: DataFrame, span: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    return stream.groupBy(F.window("ts", span, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"))


def once(stream: DataFrame, *key: str) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(list(key))


def deliveries(messages: DataFrame, changes: DataFrame, lease: str = "1 day") -> DataFrame:
    """``message_id, subscriber, changed_at, change_id, kind``: each message with all changes of subscriptions to its project in the ``lease`` before it.

    An interval join of two streams, ``messages`` (``project, message_id, sent_at``) and ``changes`` (``to, subscriber, changed_at, change_id, kind``),
    with watermarks on both sides: state is kept for the lease and the lateness, whatever the length of the streams. ``subscribed`` reads the result.
    """
    near = (F.col("changed_at") <= F.col("sent_at")) & (F.col("changed_at") >= F.col("sent_at") - F.expr(f"INTERVAL {lease}"))
    met = messages.join(changes, (F.col("project") == F.col("to")) & near)
    return met.select("message_id", "subscriber", "changed_at", "change_id", "kind")


def subscribed(delivered: DataFrame, kind: str) -> DataFrame:
    """``message_id, subscriber`` where the last change before the message is of this kind. Changes may come in any order, late ones too."""
    last = F.max_by("kind", F.struct("changed_at", "change_id")).alias("kind")
    return delivered.groupBy("message_id", "subscriber").agg(last).where(F.col("kind") == kind).select("message_id", "subscriber")


def cache_hits(stream: DataFrame, ttl_s: int) -> DataFrame:
    """``user_id, hits, misses`` of a cache with a key per user, kept as state; hits don't prolong an entry."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expires, hits, misses = state.get if state.exists else (-(2**62), 0, 0)
        times = sorted(t for batch in batches for t in batch["us"].tolist())
        for t in times:
            if t < expires:
                hits += 1
            else:
                misses, expires = misses + 1, t + ttl_s * 1_000_000
        state.update((expires, hits, misses))
        yield pd.DataFrame({"user_id": [key[0]], "hits": [hits], "misses": [misses]})

    rows = stream.select("user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, hits long, misses long", "expires long, hits long, misses long", "update", GroupStateTimeout.NoTimeout)
