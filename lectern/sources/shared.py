"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def base_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset and driver and executors are one process, a temporary one."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="lectern-shared-"))
    return _local[0]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{base_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def version_of(table: DataFrame) -> str:
    """A name for the present files of a table that is read from files: other files, sizes or times give another one."""
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = table.groupBy(F.xxhash64(file).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("file").cast("decimal(38,0)")).alias("sum"), F.bit_xor("file").alias("xor")).first()
    return f"{seen['n']}-{abs(int(seen['sum'] or 0)):x}-{(seen['xor'] or 0) & (2**64 - 1):x}"
