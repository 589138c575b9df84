"""Projects with their plans and papers, reports and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree(projects: DataFrame, references: DataFrame, users: DataFrame) -> DataFrame:
    """Each project with its user and the list of its papers in line order; papers are gathered before the join."""
    children = references.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("line", "paper"))).alias("papers"))
    return projects.join(children, "project_id", "left").join(users.select("user_id", "name"), "user_id", "left")


def latest(events: DataFrame, key: str, value: str, order: str, tie: str) -> DataFrame:
    """The last value of each key, an aggregate that map tasks combine."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(order, tie)).alias(value), F.max(order).alias(order))


def last_n(events: DataFrame, key: str, order: str, tie: str, n: int) -> DataFrame:
    """The ``n`` last rows of each key; the window's limit drops others before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))).cast("bigint")
    return events.withColumn("place", place).where(F.col("place") <= n)


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return rows.join(deleted, key, "left_anti")


def or_all(rows: DataFrame, chosen: str) -> DataFrame:
    """The rows where ``chosen`` holds, or all rows if it holds for none."""
    found = rows.agg(F.coalesce(F.bool_or(F.expr(chosen)), F.lit(False)).alias("found"))
    return rows.crossJoin(F.broadcast(found)).where(F.expr(chosen) | ~F.col("found")).drop("found")


def histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` counts of each key as a sorted list of ``value=count``."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat(F.col(value).cast("string"), F.lit("="), F.col("n").cast("string"))
    return counts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias(f"{value}_histogram"))


def progress(status: str, done: str, total: str):
    """Percent: fixed for most states; while analysing, 20 to 90 by the share of papers done."""
    share = F.when(F.col(total) > 0, F.col(done) / F.col(total)).otherwise(F.lit(0.0))
    return F.when(F.col(status) == "P", 5.0).when(F.col(status) == "F", 100.0).otherwise(F.round(20 + 70 * share, 4))
