"""Progress events: parsing, fan-out to subscribers, subscription counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(messages: DataFrame) -> DataFrame:
    """Project, type, message and progress of raw messages on ``project:ID:updates`` channels."""
    kind = F.col("event_type")
    text = F.when(kind == "error", "An error occurred").otherwise(F.concat(kind, F.lit(" is now running")))
    progress = F.when(kind == "purchase", 100.0).otherwise(F.least("value", F.lit(100.0)))
    return messages.select("event_id", F.split("channel", ":")[1].alias("project_id"), kind.alias("type"), text.alias("message"), progress.alias("progress"))


def fanned_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each message beside each subscriber of its project but the sender."""
    return messages.join(subscriptions, "project").where("subscriber <> sender")


def subscribers(acts: DataFrame) -> DataFrame:
    """Sockets by project whose last act was to join."""
    last = acts.groupBy("project", "socket").agg(F.max_by("joins", F.struct("ts", "event_id")).alias("joined"))
    return last.where("joined").groupBy("project").agg(F.count(F.lit(1)).alias("subscribers"))


def progress_event(kind: Column, agent: Column, title: Column, progress: Column) -> Column:
    """An event as compact JSON, empty fields left out: status, progress, paper, completion or error by ``kind``."""
    by = F.when(kind == "status", agent).when(kind == "progress", agent).when(kind == "paper_found", "retriever").when(kind == "paper_analyzed", "analyzer")
    paper = kind.isin("paper_found", "paper_analyzed")
    message = (
        F.when(kind == "status", F.concat(agent, F.lit(" is now running")))
        .when(paper, F.concat(F.lit("Paper: "), F.substring(title, 1, 50), F.lit("...")))
        .when(kind == "completed", "Literature review completed successfully")
        .when(kind == "error", "An error occurred during processing")
    )
    percent = F.when(kind == "progress", progress).when(kind == "completed", F.lit(100.0))
    data = F.when(kind == "status", F.create_map(F.lit("status"), F.lit("running"))).when(paper, F.create_map(F.lit("paper_title"), title))
    fields = F.struct(kind.alias("type"), by.alias("agent"), message.alias("message"), percent.alias("progress"), data.alias("data"))
    return F.to_json(fields, {"ignoreNullFields": "true"})


def counters(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What a viewer of the stream ``key, type, current, total, progress`` sees in the end, by key.

    ``analyzed``: the last count that a ``paper_analyzed`` event told, plus one for each later one that told none.
    ``total`` and ``progress`` are the last that were told; a completion means 100. Aggregates only, joined on the key.
    """
    at, analysed = F.struct(*order), F.col("type") == "paper_analyzed"
    known = F.when(F.col("type").isin("paper_found", "paper_analyzed") & (analysed | (F.col("total") > 0)), F.col("total"))
    percent = F.when(F.col("type") == "completed", 100.0).when(F.col("type").isin("progress", "paper_found", "paper_analyzed"), F.col("progress"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    rows = rows.withColumn("told", F.when(analysed, F.col("current")))
    ends = rows.groupBy(key).agg(last(F.col("told")).alias("base"), F.max(F.when(F.col("told").isNotNull(), at)).alias("since"), last(known).alias("total"), last(percent).alias("progress"))
    later = rows.where(analysed & F.col("told").isNull()).select(key, at.alias("at")).join(ends.select(key, "since"), key)
    later = later.where(F.col("since").isNull() | (F.col("at") > F.col("since"))).groupBy(key).agg(F.count(F.lit(1)).alias("more"))
    count = F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))
    return ends.join(later, key, "left").select(key, count.cast("bigint").alias("analyzed"), "total", "progress")
