"""Near copies by exact Jaccard similarity of word shingles, for the corpus pipeline.

The first candidates are what SimHash links by its pivot distance tables (``simhash.links``) over fingerprints of the shingles:
at most two of 64 bits apart. That finds the closest copies only: at similarity 0.8 about one bit in seven differs. All other links come
from the exact join of ``ngram_join``: with those candidates its hubs are compared, and then everything across components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .ngram_join import components, nodes_of, shared_sets
from .simhash import links as fingerprint_links


def printed(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: sets of one SimHash with the first of them, and the first ones of SimHashes that ``simhash.links`` links."""
    first = scratch.save(nodes.groupBy("print").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(first, "print").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = fingerprint_links(first.select(F.col("print").alias("fp")), scratch)
    ends = (first.select(F.col("print").alias(x), F.col("first").alias(f"first_{x}")) for x in "uv")
    return same.union(near.join(next(ends), "u").join(next(ends), "v").select(F.least("first_u", "first_v"), F.greatest("first_u", "first_v")))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, seed: int = 42, scratch: Scratch | None = None
) -> DataFrame:
    """One row per input row: id, ``component_id``, ``kept`` and ``text_hash`` (xxhash64 of the text).

    ``component_id`` is the smallest id reachable over pairs of Jaccard similarity ``percent`` or more; the row that has it is kept, of several such
    rows the one with the smallest text hash. Defined cases: null and empty texts have the empty set and link to one another only; rows that
    repeat in id and text are judged alike; null ids are never the smallest (of null ids only, the smallest text hash is kept);
    an empty table gives an empty result; other columns are not read.
    """
    scratch, own = scratch or Scratch(docs.sparkSession, "near"), Scratch(docs.sparkSession, "near-steps")
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")).alias("key"), text.alias("text"))
    rows = shared_sets(keyed, "key", "text", percent, scratch, width, seed, prints=True)
    least = F.struct(F.col("id.id").isNull().alias("none"), F.col("id.id").alias("id"), F.col("id.text_hash").alias("text_hash"))
    nodes = nodes_of(rows, own, F.min(least))
    labels = components(nodes, percent, own, printed(nodes, own))
    named = own.save(nodes.select("node", "fp", "low").join(labels, "node"), "named")
    lows = own.save(named.groupBy("label").agg(F.min("low").alias("least")), "lows")
    known = scratch.save(named.join(lows, "label").select("fp", "least"), "known")
    own.only()
    empty = rows.where("n = 0").agg(F.min(least).alias("least"))  # one row
    out = [
        rows.where("able").join(known, "fp").select("id", "least"),
        rows.where("NOT able AND n > 0").select("id", least.alias("least")),
        rows.where("n = 0").crossJoin(F.broadcast(empty)).select("id", "least"),
    ]
    kept = F.col("id.id").eqNullSafe(F.col("least.id")) & F.col("id.text_hash").eqNullSafe(F.col("least.text_hash"))
    whole = out[0].union(out[1]).union(out[2])
    return whole.select(F.col("id.id").alias(id_col), F.col("least.id").alias("component_id"), kept.alias("kept"), F.col("id.text_hash").alias("text_hash"))
