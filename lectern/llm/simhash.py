"""SimHash near-dedup by pivot distance tables.

Every document gets a 64-bit fingerprint of its word shingles. For the different fingerprints, tables of Hamming
distances to ``PIVOTS`` reference fingerprints are precomputed, one coordinate per pivot and 16-bit band. A bit flip
changes a pivot's distance on one band only, so two fingerprints at most two bits apart agree in all coordinates on at
least two of the four bands: these coordinate vectors are the join key. A candidate pair is discarded when
any whole-fingerprint coordinate differs by more than the radius, and survivors are verified bit by bit.

Cells of more than ``CELL`` different fingerprints are not paired. Their members meet at hubs: two fingerprints are within
two bits exactly when they share a fingerprint within one bit of both, so each member goes to its 65 hubs, linear in
the members whatever their density.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, slices, utf8
from .components import connected_components

PIVOTS = 16
CELL = 32
RADIUS = 2
BANDS = (0xFFFF, 0xFFFF0000, 0xFFFF00000000, -0x1000000000000)

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of whole ``text``: words between ASCII white space, A-Z lower-cased, ``width``-word shingles.

    Fewer words give one shingle of them all; no word gives zero. A bit is 1 if set in over half the shingle hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return bits_of(np.array([digest(join(s), seed) for s in zip(*(words[i:] for i in range(width)))], dtype="<u8"))


def bits_of(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit ``hashes`` have; zero without any."""
    octets = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            fps = np.array([fingerprint(t or b"", width, seed) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """``n`` seeded reference fingerprints, as signed longs."""
    return [int(x) for x in np.random.default_rng(20).integers(-(2**63), 2**63 - 1, n)]


def _distances(fp: Column, mask: int) -> Column:
    """Hamming distances of ``fp`` to all pivots over the bits of ``mask``."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(mask))).cast("tinyint") for p in pivots()))


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: links among the different long fingerprints of ``fps`` that have the components of all pairs
    within two bits. Pairs of crowded cells are linked through their hub's smallest member."""
    table = fps.select("fp", *(_distances(F.col("fp"), m).alias(f"d{i}") for i, m in enumerate(BANDS)))
    keys = [F.xxhash64(F.lit(i), f"d{a}", f"d{b}") for i, (a, b) in enumerate(combinations(range(4), 2))]
    whole = reduce(lambda x, y: F.zip_with(x, y, lambda p, q: (p + q).cast("tinyint")), [F.col(f"d{i}") for i in range(4)])
    cells = scratch.save(table.select("fp", whole.alias("d"), F.explode(F.array(*keys)).alias("cell")), "cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = scratch.save(cells.join(scratch.save(sizes, "sizes"), "cell"), "shared")

    light = cells.where(F.col("n") <= CELL)
    a, b = light.select("cell", F.col("fp").alias("u"), F.col("d").alias("du")), light.select("cell", F.col("fp").alias("v"), F.col("d").alias("dv"))
    pairs = a.join(b, "cell").where("u < v")
    near = F.forall(F.zip_with("du", "dv", lambda x, y: F.abs(x - y)), lambda x: x <= RADIUS)
    pairs = pairs.where(near).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")

    crowd = cells.where(F.col("n") > CELL).select("fp").distinct()
    flips = F.array(F.lit(0), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    at = crowd.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("hub"))
    at = scratch.save(at, "hubs")
    first = scratch.save(at.groupBy("hub").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", "v"), "first")
    met = at.join(first, "hub").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(met).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 lowercase hex digits), ``component_id``, ``fp_docs``.

    ``component_id`` is the smallest id reachable over fingerprints at most two bits apart; ``fp_docs`` counts the rows with
    the same fingerprint. Defined cases: null and empty texts have fingerprint zero and link like any other; rows
    that repeat count singly; null ids are kept and never the smallest (a component of null ids only has a null one);
    an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, width, seed), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = connected_components(scratch.save(links(nodes, scratch), "links"), scratch)
    named = scratch.save(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    lows = scratch.save(named.groupBy("label").agg(F.min("low").alias("component_id")), "lows")
    known = scratch.save(named.join(lows, "label").select("fp", "component_id", F.col("n").alias("fp_docs")), "known")
    out = prints.join(known, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_docs")
