"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each quantised to the nearest of K centroids; a cell is a pair of centroids. A query walks
the pairs in order of summed closeness with a heap until the cells walked hold a share of all rows, and the rows in
them are ranked anew on the original vectors. Codebooks and share are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices

SAMPLE = 8192
BLOCK_ROWS = 4096
#: Numbers in the queries that meet a block at a time: the index is copied once for each such chunk of queries.
CHUNK_NUMBERS = 1 << 22
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """True for a vector that isn't null, empty or zero and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from spread-out rows; the points come in a fixed order, so the result is fixed."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=k)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


class Codebook:
    """Two sets of centroids and the share of rows to walk."""

    def __init__(self, sample: np.ndarray, k: int, recall: float, top: int):
        self.half, self.k = sample.shape[1] // 2, k
        self.left, self.right = _kmeans(sample[:, : self.half], k), _kmeans(sample[:, self.half :], k)
        self.share = self._tune(sample, recall, top)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors[:, : self.half], self.left) * self.k + _nearest(vectors[:, self.half :], self.right)

    def closeness(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.left @ query[: self.half], self.right @ query[self.half :]

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells in order of summed closeness (inner product), by a heap over centroid pairs."""
        a, b = self.closeness(query)
        order_a, order_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        near_a, near_b = a[order_a].tolist(), b[order_b].tolist()
        heap, k = [(-(near_a[0] + near_b[0]), 0, 0)], self.k
        while heap:
            _, i, j = heapq.heappop(heap)
            yield order_a[i] * k + order_b[j]
            # (i, j + 1) follows (i, j); a new row is entered at its first column only, so no pair comes twice
            if j + 1 < k:
                heapq.heappush(heap, (-(near_a[i] + near_b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (-(near_a[i + 1] + near_b[0]), i + 1, 0))

    def _tune(self, sample: np.ndarray, recall: float, top: int) -> float:
        """The share of rows within which ``recall`` of the true neighbours of sample queries lie."""
        queries, cells = sample[:: max(1, len(sample) // 256)], self.cells(sample)
        sizes = np.bincount(cells, minlength=self.k**2)
        reached = []
        for query in queries:
            a, b = self.closeness(query)
            order = np.argsort(-(a[:, None] + b[None, :]).ravel(), kind="stable")
            walked = np.empty(len(order))
            walked[order] = np.cumsum(sizes[order])
            best = np.argsort(-(sample @ query), kind="stable")[: top + 1]
            reached.append(walked[cells[best]] / len(sample))
        return float(np.quantile(np.concatenate(reached), recall))


def nearest(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = 20, recall: float = 0.95,
    centroids: int | None = None, sample_rows: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows found nearest to each row whose id is divisible by ``every``.

    Nearness is the largest inner product in double precision, ties to the smaller id; a row isn't its own neighbour.
    Defined cases: null ids, and vectors that are null, empty, zero or hold null or non-finite numbers, take no part; vectors of different
    lengths have no product, so each length is an index of its own, made one after another; rows that repeat an id
    are candidates singly; queries without any candidate have no row; other columns are not read.
    """
    spark = rows.sparkSession
    read = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    read = read.where(usable(F.col("v")) & F.col("id").isNotNull())
    shapes = read.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()  # a row for each length
    found = [_of_one_length(read.where(F.size("v") == r["dim"]), r["dim"], r["count"], every, top, recall, centroids, sample_rows) for r in shapes]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_one_length(read: DataFrame, dim: int, total: int, every: int, top: int, recall: float, centroids: int | None, sample_rows: int) -> DataFrame:
    """``nearest`` for usable vectors ``id, v`` of ``dim`` numbers, ``total`` in all."""
    scratch = Scratch(read.sparkSession, "ann")
    k = centroids or max(4, min(256, int(total**0.4 / 1.2)))
    # the sample is bounded: about sample_rows rows, chosen by a hash of their id
    lot = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = np.array([r["v"] for r in read.where(lot < min(1.0, sample_rows / total)).orderBy("id").limit(2 * sample_rows).collect()])
    if not len(sample):
        sample = np.array([read.orderBy("id").first()["v"]])
    book = Codebook(sample, min(k, len(sample)), recall, top)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if batch.num_rows:
                cells = book.cells(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int32())], ["id", "v", "cell"])

    index = scratch.save(read.mapInArrow(quantise, "id long, v array<double>, cell int"), "index")
    sizes = np.zeros(book.k**2, dtype=np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # k * k rows at most
        sizes[cell] = n
    # cells in a row share a block of about BLOCK_ROWS rows; a larger cell is split over blocks of its own
    first, parts, at, filled = np.zeros(book.k**2, int), np.ones(book.k**2, int), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > BLOCK_ROWS:
            at += filled > 0
            first[cell], parts[cell], filled = at, -(-n // BLOCK_ROWS), 0
            at += parts[cell]
            continue
        if filled + n > BLOCK_ROWS:
            at, filled = at + 1, 0
        first[cell], filled = at, filled + n
    need = max(int(np.ceil(book.share * total)), min(total, top + 1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query and block with a walked cell: the block's walked cells."""
        for batch in slices(batches, 256):
            out_row, out_block, out_cells = [], [], []
            for row, query in enumerate(_matrix(batch.column(1), dim) if batch.num_rows else ()):
                walked, got = [], 0
                for cell in book.walk(query):
                    if sizes[cell]:
                        walked.append(cell)
                        got += sizes[cell]
                    if got >= need:
                        break
                blocks: dict[int, list[int]] = {}
                for cell in walked:
                    for block in range(first[cell], first[cell] + parts[cell]):
                        blocks.setdefault(block, []).append(cell)
                for block, cells in blocks.items():
                    out_row.append(row), out_block.append(block), out_cells.append(np.array(cells, "<i4").tobytes())
            taken = batch.take(pa.array(out_row, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(out_block, pa.int32()), pa.array(out_cells, pa.binary())], ["id", "v", "block", "cells"])

    queries = index.where(F.pmod("id", F.lit(every)) == 0).select("id", "v")
    routed = scratch.save(queries.mapInArrow(route, "id long, v array<double>, block int, cells binary"), "routed")
    chunks = max(1, -(-queries.count() // max(1024, CHUNK_NUMBERS // dim)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's block; rows of a split cell are spread over its blocks by a hash of their id."""
        for batch in slices(batches, 65536):
            ids, cells = batch.column(0).to_numpy().astype(np.uint64), batch.column(2).to_numpy()
            spread = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((first[cells] + spread % parts[cells]).astype(np.int32))], ["id", "v", "cell", "block"])

    placed = index.mapInArrow(place, "id long, v array<double>, cell int, block int")
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    routed = routed.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(chunks)).cast("int"))

    def rank(key: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The block's ``top`` best for each query of the chunk, among the cells it walked."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(block) and len(asked):
            vectors, ids, cells = np.stack(block["v"].to_numpy()), block["id"].to_numpy(), block["cell"].to_numpy()
            known, cell_at = np.unique(cells, return_inverse=True)
            for start in range(0, len(asked), 256):
                part = asked.iloc[start : start + 256]
                q = np.stack(part["v"].to_numpy())
                close = q @ vectors.T
                for row, (query, walked) in enumerate(zip(part["id"].to_numpy(), part["cells"])):
                    seen = np.isin(known, np.frombuffer(walked, "<i4"))[cell_at] & (ids != query)
                    at = np.flatnonzero(seen)
                    if len(at) > top:
                        near = close[row, at]
                        at = at[near >= np.partition(near, -top)[-top] - SLACK]
                    # one way of adding up for every row, so that equal vectors have equal scores
                    score = (vectors[at] * q[row]).sum(axis=1)
                    best = np.lexsort((ids[at], -score))[:top]
                    out.append((np.full(len(best), query), ids[at[best]], score[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = placed.groupBy("block", "chunk").cogroup(routed.groupBy("block", "chunk")).applyInPandas(rank, "query_id long, vec_id long, score double")
    found = scratch.save(found, "found")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
