"""Records of several sources: dedup, numbering, federation, upserts and memos."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import ordered


def first_per_title(papers: DataFrame, order: str = "arrival") -> DataFrame:
    """The first arrival of each title, compared trimmed and lower-cased; empty titles go.

    Titles may be hot: the first arrival is an aggregate that map tasks combine, and the join back is on two keys.
    """
    norm = F.lower(F.trim("title"))
    named = papers.withColumn("norm", norm).where("norm <> ''")
    first = named.groupBy("norm").agg(F.min(order).alias(order))
    return named.join(first, ["norm", order], "left_semi").drop("norm")


def numbered(papers: DataFrame, key: str, order: str = "arrival", prefix: str = "paper_") -> DataFrame:
    """``id``: the place in order of arrival within the key, from 0."""
    placed = ordered.numbered(papers, key, order)
    return placed.withColumn("id", F.concat(F.lit(prefix), F.col("number").cast("string"))).drop("number")


def federated(papers: DataFrame, terms: tuple[str, ...], per_source: int, most: int) -> DataFrame:
    """At most ``per_source`` hits of each term and source, united, one per title, ``most`` in all."""
    found = [papers.where(F.lower("abstract").contains(t)).withColumn("term", F.lit(t)) for t in terms]
    place = F.row_number().over(Window.partitionBy("term", "source").orderBy("arrival"))
    some = reduce(DataFrame.unionByName, found).withColumn("place", place).where(F.col("place") <= per_source)
    once = F.row_number().over(Window.partitionBy(F.lower(F.trim("title"))).orderBy("term", "arrival"))
    return some.withColumn("once", once).where("once = 1").orderBy("term", "arrival").limit(most)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key of both tables."""
    rest = [c for c in new.columns if c not in (key, version)]
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max(version).alias(version), *(F.max_by(c, version).alias(c) for c in rest))


def memoized(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``cached``: an earlier row has the key; ``source_of``: the order of that first row."""
    first = rows.groupBy(key).agg(F.min(order).alias("source_of"))
    return rows.join(first, key).withColumn("cached", F.col(order) > F.col("source_of"))
