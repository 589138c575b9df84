"""What the operators share: tables written between steps, and small helpers for Arrow stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that Arrow stages take apart at a time.
PORTION = 1 << 18
#: Lets shuffle files go when the query that made them ends, not when the driver's garbage collection gets to them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch between Spark and Python, where the session has Spark's default: whole texts are wide rows, which both sides hold.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

_held: dict[tuple, object] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named and driver and executors are one process (tests), a new local one."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
    own = "file://" + tempfile.mkdtemp(prefix="lectern-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, for the rest of the session; a number that its user has set stays."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


class Scratch:
    """Tables written to the shared checkpoint folder between the steps of one operator.

    Written tables cut the lineage: a lost executor costs the running tasks, not the steps before.
    Superseded tables go with ``drop`` and ``only``; the rest when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/lectern-{label}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        self.tables: list[str] = []
        atexit.register(self._remove, self.path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # the session may have ended first; the folder is the cluster's to clear then
            pass

    def folder(self, name: str) -> str:
        self.made += 1
        return f"{self.path}/{self.made:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table. Its shuffles end with it: what follows reads the table."""
        folder = self.folder(name)
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(folder)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        self.tables.append(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        out._scratch = folder
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.tables.remove(table._scratch)
            self._remove(table._scratch)

    def only(self, *tables: DataFrame) -> None:
        """Drop all tables but these."""
        left = [t._scratch for t in tables]
        for folder in self.tables:
            if folder not in left:
                self._remove(folder)
        self.tables = left


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed.

    Pure ASCII text takes the engine's byte-wise lower(); other text the slower per-character translate().
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_crc32(column: Column) -> Column:
    """crc32 of the id's decimal text, for held-out folds."""
    return F.crc32(column.cast("string").cast("binary"))


def held(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept in this Python worker for the tasks to come until another key is asked for.

    One thing only is kept: a worker serves one operator after another, and their caches together would not fit.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give up what ``held`` keeps here: a stage that needs none of it starts."""
    _held.clear()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that Python objects of one piece stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def portions(texts: list[bytes | None], size: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is alone."""
    start = total = 0
    for i, text in enumerate(texts):
        length = len(text or b"")
        if i > start and total + length > size:
            yield start, i
            start, total = i, 0
        total += length
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of a column as bytes; null stays None."""
    return column.cast(pa.binary()).to_pylist()


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
