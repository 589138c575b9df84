"""Work in the order of a key's rows, split over tasks however many rows a key has.

Rows are sorted over range partitions and written with their place; partial results of slices of them are combined, and the rest is done slice by slice.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources import shared

#: Rows of a slice, as a power of two.
SLICE_BITS = 12


def sliced(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with ``slice``, rising with ``order`` within each key, and ``place``, rising within each slice. A written table."""
    # the partition's number, then the row's place in it
    place = F.monotonically_increasing_id()
    folder = shared.new_folder(rows.sparkSession, "ordered")
    rows.orderBy(key, order).withColumn("place", place).withColumn("slice", F.shiftright("place", SLICE_BITS)).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``number``: the place of each row in its key, from 0. What is windowed is a row for each slice of a key."""
    placed = sliced(rows, key, order)
    slices = placed.groupBy(key, "slice").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col(key).alias("_key"), "slice", "first", before.alias("before"))
    met = placed.withColumnRenamed("slice", "_slice").join(slices, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("slice")))
    return met.select(*rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("number"))


def _starts(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a bin that starts at each item of a slice: the item that starts the next one; how many bins start up to the end; how full the last one is, -1 if closed."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    over = np.flatnonzero(lengths > limit)
    following = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    barrier = np.concatenate([over, [n]])[np.searchsorted(over, np.arange(n))]
    following = np.minimum(following, barrier)
    following[over] = over + 1
    bins, full = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
    for i in range(n - 1, -1, -1):
        after = following[i]
        bins[i] = 1 + bins[after]
        full[i] = full[after] if after < n else -1 if lengths[i] > limit else total[n] - total[i]
    return following, bins, full


def _summary(lengths: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """What a slice does to the bin that is open before it, by the item that no longer fits there: the characters up to this item, and the bins and fill that follow.

    The last entry is for a bin that takes all items, if it can; only items up to ``limit`` characters or to the first one over it matter.
    """
    _, bins, full = _starts(lengths, limit)
    total = np.concatenate([[0], np.cumsum(lengths)])
    over = np.flatnonzero(lengths > limit)
    last = min(int(np.searchsorted(total, limit, side="right")) - 1, int(over[0]) if len(over) else len(lengths))
    return total[: last + 1].tolist(), bins[: last + 1].tolist(), full[: last + 1].tolist()


def bins(items: DataFrame, key: str, order: str, length: str, limit: int) -> DataFrame:
    """``bin`` (from 0) and ``cut`` of each row: a key's items in order, in bins of ``limit`` characters; one over the limit is alone and ``cut``.

    Slices are summed up by what they do to an open bin, the sums are chained per key (a row for each slice), and slices are then filled from
    the state that they begin with. Null lengths count as 0.
    """
    placed = sliced(items.withColumn("_length", F.coalesce(F.col(length).cast("long"), F.lit(0))), key, order)
    kind, names = placed.schema[key].dataType.simpleString(), items.columns

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        ends, count, full = _summary(table.column("_length").to_numpy(), limit)
        total = int(np.sum(table.column("_length").to_numpy()))
        whole = len(ends) == len(table) + 1
        made = {key: table.column(key)[:1], "slice": table.column("slice")[:1]}
        return pa.table(made | {"ends": [ends], "bins": [count], "full": [full], "total": [total], "whole": [whole]})

    sums = placed.select(key, "slice", "place", "_length").groupBy(key, "slice")
    sums = sums.applyInArrow(summed, f"{key} {kind}, slice long, ends array<long>, bins array<long>, full array<long>, total long, whole boolean")

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        used, fill, first, before = 0, -1, [], []
        for ends, count, full, total, whole in zip(*(table.column(c).to_pylist() for c in ("ends", "bins", "full", "total", "whole"))):
            first.append(used)
            before.append(fill)
            # the first item that doesn't fit what is open; without an open bin the first of all
            at = bisect_right(ends, limit - fill) - 1 if fill >= 0 else 0
            if fill >= 0 and whole and at == len(ends) - 1:
                fill += total
            else:
                used, fill = used + count[at], full[at]
        return pa.table({"_key": table.column(key), "_slice": table.column("slice"), "used": pa.array(first, pa.int64()), "fill": pa.array(before, pa.int64())})

    states = sums.groupBy(key).applyInArrow(chained, f"_key {kind}, _slice long, used long, fill long")
    met = placed.join(states, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice"))).drop("_slice")

    def filled(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        lengths = table.column("_length").to_numpy()
        used, fill = table.column("used")[0].as_py(), table.column("fill")[0].as_py()
        following, _, _ = _starts(lengths, limit)
        number = np.zeros(len(lengths), np.int64)
        at = 0
        if fill >= 0:
            fits = (np.cumsum(lengths) + fill <= limit) & (np.cumsum(lengths > limit) == 0)
            at = len(lengths) if fits.all() else int(np.argmin(fits))
            number[:at] = used - 1
        while at < len(lengths):
            number[at : following[at]] = used
            used, at = used + 1, following[at]
        kept = table.select(names)
        return kept.append_column("bin", pa.array(number)).append_column("cut", pa.array(lengths > limit))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return met.groupBy("_key", "slice").applyInArrow(filled, f"{schema}, bin long, cut boolean")
