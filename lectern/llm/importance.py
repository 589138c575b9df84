"""Importance resampling towards a target distribution of hashed word runs.

Two passes over the texts. In the first every partition counts the hashed features of its texts in one vector (``np.bincount``), and a tree
reduction adds the vectors up; the driver gets one vector of ``buckets`` numbers a table, whatever the number of texts. Source
and target give a gain for each bucket. In the second pass the gains are broadcast, again ``buckets`` numbers, and a document's weight is the sum of its features' gains.
Gumbel noise from the id's hash makes the highest scores a draw without replacement in proportion to the weights. Scores are
ranked by a range-partitioned sort: rows are numbered in their partitions, and the partitions' counts shift the numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, crc32, slices, utf8

#: A-Z become a-z; other ASCII but letters and digits becomes a space; bytes of longer characters stay.
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Different features whose buckets a Python worker keeps.
_KNOWN = 1 << 18
#: Partitions' vectors that meet in one step of the tree at most.
_FAN_IN = 64


class _Buckets(dict):
    """Bucket of a feature's bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[feature] = out = crc32(feature) % self.buckets
        return out


@dataclass(frozen=True)
class Hashing:
    """How a text becomes features: runs of 1 to ``width`` words, hashed to ``buckets``."""

    width: int = 1
    buckets: int = 10_000

    def features(self, text: bytes | None, known: _Buckets) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all features."""
        words = (text or b"").translate(_CLEAN).split()
        runs = [words, *(list(map(b" ".join, zip(*(words[i:] for i in range(n))))) for n in range(2, self.width + 1))]
        total = sum(map(len, runs))
        return len(words), np.fromiter((known[w] for run in runs for w in run), dtype=np.int64, count=total)


def bucket_counts(texts: DataFrame, text_col: str, hashing: Hashing) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Buckets(hashing.buckets), np.zeros(hashing.buckets, dtype=np.int64)
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                counts += np.bincount(hashing.features(text, known)[1], minlength=hashing.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "counts binary").rdd
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(hashing.buckets, dtype=np.int64)
    zero = np.zeros(hashing.buckets, dtype=np.int64).tobytes()
    # a partition without input may give no row; every partition has a vector to reduce so
    whole = vectors.mapPartitions(lambda rows: iter([sum((np.frombuffer(r.counts, np.int64) for r in rows), np.frombuffer(zero, np.int64))]))
    return whole.treeReduce(np.add, depth=max(2, math.ceil(math.log(parts, _FAN_IN))))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floor of 1000 times the logarithm of the smoothed ratio of its shares in target and source."""
    n, many, few = len(source), int(source.sum()), int(target.sum())
    ratio = [(t + 1.0) * (many + float(n)) / ((s + 1.0) * (few + float(n))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.float64)


def noise(seed: int, doc_id: object) -> int:
    """Gumbel noise of an id in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, by_bucket: np.ndarray, id_col: str, text_col: str, hashing: Hashing, seed: int) -> DataFrame:
    """``id, n_words, n_features, weight, score`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(hashing.buckets)
        for batch in slices(batches):
            each = [hashing.features(t, known) for t in utf8(batch.column(1))]
            sizes = [len(f) for _, f in each]
            owner = np.repeat(np.arange(len(each)), sizes)
            found = np.concatenate([f for _, f in each]) if each else np.zeros(0, np.int64)
            weights = np.bincount(owner, weights=sent.value[found], minlength=len(each)).astype(np.int64)
            scores = weights + np.array([noise(seed, i) for i in batch.column(0).to_pylist()], dtype=np.int64)
            columns = [pa.array([n for n, _ in each], pa.int64()), pa.array(sizes, pa.int64()), pa.array(weights), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_features", "weight", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank``, from 1 by falling score, ties to the smaller id."""
    place = F.monotonically_increasing_id()  # the partition's number, then the row's place in it
    placed = scratch.save(rows.orderBy(F.desc("score"), F.asc_nulls_last("id")).withColumn("place", place), "placed")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    shifts, total = [], 0
    for r in counts:
        shifts.append((r.part, total))
        total += r.n
    shift = rows.sparkSession.createDataFrame(shifts, "part long, shift long")
    return placed.withColumn("part", part).join(F.broadcast(shift), "part").select(*rows.columns, (F.col("shift") + within + 1).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    least_words: int = 20,
    width: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
) -> DataFrame:
    """One row per input row: id, ``n_features``, ``weight``, ``score``, ``rank``.

    Of the rows with ``least_words`` words or more, ``share`` percent (rounded down) with the highest scores are drawn; ``rank`` is their
    place and null for all others. Words are runs of letters and digits of ASCII (A-Z lower-cased) and of all other characters.
    Defined cases: null and empty texts have no features, weight 0, and are never drawn; a null id counts as empty text in the noise and comes last among ties;
    rows that repeat are drawn singly; an empty ``target`` or ``docs`` has counts of zero; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch, hashing = Scratch(spark, "importance"), Hashing(width, buckets)
    by_bucket = gains(bucket_counts(docs, text_col, hashing), bucket_counts(target, target_col, hashing))
    rows = scratch.save(weigh(docs, by_bucket, id_col, text_col, hashing, seed), "rows")
    enough = rows.where(F.col("n_words") >= least_words)
    placed = scratch.save(ranked(enough, scratch), "ranked")
    drawn = share * placed.count() // 100
    out = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = out.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
