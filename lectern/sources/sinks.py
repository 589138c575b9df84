"""Sinks: appends, upserts and deletes in Parquet folders partitioned by a key.

A folder holds one partition for each value of its key (a project). Writes replace whole partitions that change, through a new
folder beside the old one, so that a reader sees either version and a failed write leaves the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import records
from lectern.sources import shared


def append(rows: DataFrame, folder: str, key: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(key) if key else writer).parquet(folder)


def replace(rows: DataFrame, folder: str, key: str) -> None:
    """Overwrite the partitions of the keys in ``rows`` and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def upsert(spark: SparkSession, new: DataFrame, folder: str, staged: str, key: str, row_id: str, version: str) -> None:
    """The latest version of each row: old rows of the keys in ``new`` are read with it, merged and put back.

    ``staged`` is a folder for the merged rows: a partition can't be overwritten while it is read.
    """
    touched = new.select(key).distinct()
    old = spark.read.parquet(folder).join(touched, key, "left_semi").select(new.columns)
    records.upserted(old, new, row_id, version).select(new.columns).write.mode("overwrite").parquet(staged)
    replace(spark.read.parquet(staged), folder, key)


def delete(spark: SparkSession, folder: str, rest: str, gone: DataFrame, key: str) -> None:
    """Write to ``rest`` the rows of ``folder`` whose key isn't in ``gone``."""
    spark.read.parquet(folder).join(gone, key, "left_anti").write.mode("overwrite").partitionBy(key).parquet(rest)


def trace(rows: DataFrame, folder: str, service: str) -> None:
    """Rows as JSON lines, each with the service's name; empty fields are left out."""
    line = F.to_json(F.struct(F.lit(service).alias("service"), *rows.columns), {"ignoreNullFields": "true"})
    rows.select(line.alias("value")).write.mode("append").text(folder)


class RollUp:
    """Sums by key that a stream adds to, each of its batches once, in ``folder``.

    A batch's partial sums are a table under the batch's number. A batch that comes again after a failure replaces its own table with the same sums, and
    one that ``compact`` has taken in already is left out. ``compact`` writes all batches so far as one base, and a record that makes it valid.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], sums: dict[str, str]):
        """``keys`` and ``sums``: columns and their types."""
        self.spark, self.folder, self.keys, self.sums = spark, folder.rstrip("/"), keys, sums
        self.schema = ", ".join(f"`{c}` {t}" for c, t in (keys | sums).items())

    def upto(self) -> int:
        """The last batch that the base holds; -1 without a base."""
        if not shared.exists(self.spark, f"{self.folder}/bases"):
            return -1
        records_ = self.spark.read.schema("upto long").option("recursiveFileLookup", "true").json(f"{self.folder}/bases")
        return max((r.upto for r in records_.collect()), default=-1)

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds the rows of a batch; for ``foreachBatch``."""
        if number > self.upto():
            self._summed(batch).write.mode("overwrite").parquet(f"{self.folder}/batches/batch={number}")

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.sum(c).cast(t).alias(c) for c, t in self.sums.items()))

    def _parts(self, upto: int) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        if upto >= 0:
            out = out.union(self.spark.read.schema(self.schema).parquet(f"{self.folder}/base/upto={upto}"))
        if shared.exists(self.spark, f"{self.folder}/batches"):
            later = self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.folder}/batches").where(F.col("batch") > upto)
            out = out.union(later.drop("batch"))
        return out

    def read(self) -> DataFrame:
        return self._summed(self._parts(self.upto()))

    def compact(self) -> None:
        """One base of all batches so far."""
        if not shared.exists(self.spark, f"{self.folder}/batches"):
            return
        last = self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.folder}/batches").agg(F.max("batch")).first()[0]
        if last is not None and last > self.upto():
            self.read().write.mode("overwrite").parquet(f"{self.folder}/base/upto={last}")
            self.spark.createDataFrame([(last,)], "upto long").coalesce(1).write.json(f"{self.folder}/bases/{last}")
