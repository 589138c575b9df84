"""Connected components over an edge table, in a logarithmic number of written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """``node, label``: each node of ``edges`` (long columns ``u`` and ``v``) with the smallest node it reaches.

    Each round hooks every node, and its label, to the smallest grandparent among the neighbours, then shortcuts. Labels
    only fall, so an unchanged sum of labels ends the loop. All joins stand on plain shuffles of written tables,
    which AQE can split where many nodes share a label. Self-loops name their node; null ends are ignored.
    """
    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    both = scratch.save(edges.union(edges.select("v", "u")).distinct(), "edges")
    first = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    labels = scratch.save(first.select("node", F.least("node", "low").alias("label")), "labels")
    total = _sum(labels)
    for _ in range(max_rounds):
        parent = labels.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        labelled = scratch.save(labels.join(parent, "label"), "grand")
        seen = both.join(labelled.select(F.col("node").alias("u"), "grand"), "u")
        best = scratch.save(seen.groupBy("v").agg(F.min("grand").alias("best")), "best")
        hooks = labelled.join(best.withColumnRenamed("v", "node"), "node", "left")
        low = F.least("label", "grand", "best")
        moves = hooks.select(F.explode(F.array(F.struct("node", low.alias("to")), F.struct(F.col("label").alias("node"), low.alias("to")))).alias("m"))
        new = scratch.save(moves.groupBy(F.col("m.node").alias("node")).agg(F.min("m.to").alias("label")), "labels")
        scratch.drop(labels, labelled, best)
        labels, before, total = new, total, _sum(new)
        if total == before:
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _sum(labels: DataFrame) -> object:
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
