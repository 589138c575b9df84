"""Exact vector search: a set of queries against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that one task multiplies at a time.
BLOCK = 4096
#: Queries of a block whose scores a task holds at a time.
ASKED = 256
LEAST = -np.inf


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest entries of each row, equal ones from the left; those of LEAST are none."""
    if score.shape[1] > k:
        enough = np.partition(score, -k, axis=1)[:, -k]
        row, column = np.nonzero((score >= enough[:, None]) & (score > LEAST))
    else:
        row, column = np.nonzero(score > LEAST)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, per: str | None = None, others_only: bool = False) -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` rows nearest to each query by cosine, ties to the smaller id.

    ``vectors`` has ``id, embedding`` and, if asked for, ``per``: then only the best row of each of its values counts, and the column is
    returned. ``queries`` has ``query_id, query``. Scores below ``least`` don't count, nor with ``others_only`` a query's own id, nor vectors that
    are null, of another length than the query, or zero. Rows and queries may be any number: each block of BLOCK rows meets each of BLOCK
    queries in a task, which passes on ``k`` rows a query.
    """
    group = F.col(per).cast("string") if per else F.lit(None).cast("string")
    rows = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), group.alias("per"))
    asked = queries.where("query IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("q"))
    parts = max(1, -(-rows.count() // BLOCK))
    chunks = max(1, -(-asked.count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def met(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """The best of one length of vectors."""
        own = own.sort_values(["per", "id"], kind="stable", na_position="first")
        ids, v = own["id"].to_numpy(), np.stack(own["v"].to_numpy())
        queries, q = wanted["query_id"].to_numpy(), np.stack(wanted["q"].to_numpy())
        size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(q @ v.T / size, 6) + 0.0
        score[~(score >= least)] = LEAST
        if others_only:
            score[queries[:, None] == ids[None, :]] = LEAST
        if per:
            names = own["per"].fillna("").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            row, group = _best(np.maximum.reduceat(score, starts, axis=1), k)
            ends = np.append(starts[1:], len(ids))
            column = np.array([starts[g] + np.argmax(score[r, starts[g] : ends[g]]) for r, g in zip(row, group)], dtype=int)
        else:
            row, column = _best(score, k)
        return pd.DataFrame({"query_id": queries[row], "id": ids[column], "per": own["per"].to_numpy()[column], "score": score[row, column]})

    def task(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        lengths = block["v"].map(len), chunk["q"].map(len)
        both = sorted(set(lengths[0]) & set(lengths[1]) - {0})
        sides = [(block[lengths[0] == n], chunk[lengths[1] == n]) for n in both]
        found = [met(own, wanted.iloc[i : i + ASKED]) for own, wanted in sides for i in range(0, len(wanted), ASKED)]
        none = pd.DataFrame({"query_id": [], "id": [], "per": [], "score": []})
        return (pd.concat(found) if found else none).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    found = rows.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(task, "query_id long, id long, per string, score double")
    if per:
        order = Window.partitionBy("query_id", "per").orderBy(F.desc("score"), "id")
        found = found.withColumn("place", F.row_number().over(order)).where("place = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("bigint")
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "id", *([F.col("per").cast(vectors.schema[per].dataType).alias(per)] if per else []), "score", "rank")
