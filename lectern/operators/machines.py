"""Sequential state machines over ordered rows, and their trailing windows.

A machine runs in one pass over rows sorted by key and order within partitions: it holds the state of one key, however many
rows a key has. ``step`` is a small function of the state and a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], added: str) -> DataFrame:
    """``rows`` with the columns ``added`` (DDL), the values that ``step(state, row)`` returns for each row in order."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(added).fields])
    names = schema.fieldNames()[len(rows.columns) :]

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, object()
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                if (now := getattr(row, key)) != at:
                    state, at = start(), now
                made.append(step(state, row))
            yield pd.concat([batch, pd.DataFrame(made, columns=names, index=batch.index)], axis=1)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(through, schema)


class TtlCache:
    """A hit if an earlier miss is younger than ``ttl``; hits don't prolong it."""

    def __init__(self):
        self.expires = None

    def step(self, t: float, ttl: float) -> bool:
        hit = self.expires is not None and t < self.expires
        if not hit:
            self.expires = t + ttl
        return hit


class Breaker:
    """Opens after ``failures`` in a row; after ``rest`` one call may try, and closes it by succeeding."""

    def __init__(self):
        self.failed, self.opened = 0, None

    def step(self, t: float, ok: bool, failures: int, rest: float) -> str:
        if self.opened is not None and t - self.opened < rest:
            return "rejected"
        if ok:
            self.failed, self.opened = 0, None
            return "closed"
        self.failed += 1
        if self.failed >= failures or self.opened is not None:
            self.opened = t
            return "open"
        return "closed"


class Spending:
    """Tasks take their tier while the budget allows; near its end all take the cheapest."""

    def __init__(self):
        self.spent = 0.0

    def step(self, tier: str, tokens: int, budget: float, prices: dict[str, float]) -> tuple[str, float]:
        price = lambda name: tokens * 2 / 1000 * prices[name]
        if self.spent / budget >= 0.8 or self.spent + price(tier) > budget * 0.9:
            tier = "fast_cheap"
        self.spent += price(tier)
        return tier, round(self.spent, 9)


class Progress:
    """Total percent of a run of weighted stages; entering a stage completes the one before."""

    def __init__(self):
        self.current, self.percent, self.done = None, 0.0, set()

    def step(self, stage: str, percent: float, weights: dict[str, int]) -> float:
        if stage != self.current:
            if self.current is not None:
                self.done.add(self.current)
            self.current, self.percent = stage, 0.0
        if percent >= 100:
            self.done.add(stage)
        else:
            self.percent = percent
        running = 0.0 if self.current in self.done else self.percent / 100 * weights.get(self.current, 0)
        return round(min(sum(weights.get(s, 0) for s in self.done) + running, 100.0), 4)


def trailing(rows: DataFrame, key: str, micros: str, tie: str, span_s: int, amount: str) -> DataFrame:
    """``calls_before`` and ``amount_before``: of the same key within ``span_s`` seconds before each row, itself left out.

    Rows are windowed in time slots of the span's length, with the slot before as context, so that a busy key is split.
    """
    span = span_s * 1_000_000
    slot = F.floor(F.col(micros) / span)
    slots = rows.withColumn("own", slot).withColumn("slot", F.explode(F.array(slot, slot + 1))).withColumn("offset", F.pmod(F.col(micros), F.lit(span)))
    slots = slots.withColumn("mine", F.col("slot") == F.col("own")).drop("own")
    whole = Window.partitionBy(key, "slot")
    near = whole.orderBy("offset")
    upto, before = near.rangeBetween(Window.unboundedPreceding, 0), near.rangeBetween(Window.unboundedPreceding, -1)

    def within(value: Column) -> Column:
        """Of the row's own slot what is no later; of the slot before what is at the row's offset or after it. Sums that only grow along the slot."""
        mine, other = F.when(F.col("mine"), value), F.when(~F.col("mine"), value)
        return F.coalesce(F.sum(mine).over(upto), F.lit(0)) + F.coalesce(F.sum(other).over(whole), F.lit(0)) - F.coalesce(F.sum(other).over(before), F.lit(0))

    counted = slots.withColumns({"calls_before": within(F.lit(1).cast("long")) - 1, "amount_before": within(F.col(amount)) - F.col(amount)})
    return counted.where("mine").drop("slot", "offset", "mine")


def streaks(rows: DataFrame, key: str, order: list[str], failed: str) -> DataFrame:
    """``streak``: the number of failures in a row up to each row."""
    ordered = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(F.expr(failed), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("island", island)
    inside = F.sum(F.when(F.expr(failed), 1).otherwise(0)).over(Window.partitionBy(key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return grouped.withColumn("streak", inside.cast("bigint")).drop("island")


def sessions(rows: DataFrame, key: str, micros: str, tie: str, gap_s: int) -> DataFrame:
    """``session``: counts the gaps of more than ``gap_s`` seconds before each row of the key."""
    ordered = Window.partitionBy(key).orderBy(micros, tie)
    new = F.when(F.col(micros) - F.lag(micros).over(ordered) > gap_s * 1_000_000, 1).otherwise(0)
    return rows.withColumn("new", new).withColumn("session", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("new")
