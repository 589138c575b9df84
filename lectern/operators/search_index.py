"""A stored inverted index: ranked search that reads the query's postings only, and its upkeep.

An index is a folder. Every change writes new tables and then one record to the log, which makes them valid; nothing is changed in place, so that
readers see the index before a change or after it, and an interrupted change leaves nothing but unused files.

- A *segment* holds the documents of one ``add``, ordered by length within their key and cut into parts of ``PART`` documents. Its postings have one row for
  each term and part: how many documents, the largest term frequency, the smallest length, and the entries. Rows lie in folders by a hash of
  the term, sorted by term, so that a query's scan is pruned to its words.
- *Tombstones* name documents of segments that are replaced or deleted.
- *Figures* are partial sums: documents and their lengths by key, of segments and, negative, of tombstones. A search adds up those of the
  valid tables; document frequencies come with the postings.
- ``merge`` writes what is alive as one segment, which takes the place of all before.

A search bounds each row's part of the score by the largest frequency and smallest length in it (block maxima). The part of documents with the
largest sum of bounds is scored first; its ``k``-th score is a threshold that the best ``k`` reach. Rows that can't reach
it, with the largest bounds of all other words added (MaxScore), are left out before their entries are taken apart.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import lexical
from lectern.operators.lexical import B, K1
from lectern.sources import shared

BUCKETS = 64
#: Tasks that a bucket is split over in a merge, at most.
SHARES = 4
#: Documents of a part, as a power of two.
PART_BITS = 7
LOG = "version long, segment string, gone string, replaces array<string>"
DOCS = "key string, id string, dl long, part long, seg string"
POSTINGS = "term string, key string, part long, n long, most long, least long, entries array<struct<id: string, tf: long, dl: long>>, seg string, bucket int"
#: Rows as tasks make them, before they have a bucket.
MADE = "term string, key string, part long, entries array<struct<id: string, tf: long, dl: long>>"
FIGURES = "key string, n long, total long, seg string"
GONE = "key string, id string, dl long, part long, of string, seg string"


@dataclass
class State:
    """Which tables of an index are valid."""

    version: int = 0
    segments: list[str] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)


class SearchIndex:
    """The index in ``folder``. ``key`` tells collections (projects) apart; a document's id is unique within its key."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # state

    def state(self) -> State:
        """Of the log's records, one for each change since the last merge's."""
        out = State()
        if not shared.exists(self.spark, f"{self.folder}/log"):
            return out
        for r in self.spark.read.schema(LOG).option("recursiveFileLookup", "true").json(f"{self.folder}/log").orderBy("version").collect():
            dropped = set(r.replaces or ())
            out.version = r.version
            out.segments = [s for s in out.segments if s not in dropped] + ([r.segment] if r.segment else [])
            out.gone = [g for g in out.gone if g not in dropped] + ([r.gone] if r.gone else [])
        return out

    def _commit(self, before: State, segment: str | None, gone: str | None, replaces: list[str]) -> None:
        """One record; fails if another change took the version."""
        row = self.spark.createDataFrame([(before.version + 1, segment, gone, replaces)], LOG)
        row.coalesce(1).write.json(f"{self.folder}/log/{before.version + 1:08d}")

    def _table(self, name: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").where(F.col("seg").isin(parts))

    def _dead(self, state: State) -> DataFrame:
        """``of, key, id``: the tombstones."""
        return self._table("gone", GONE, state.gone).select(F.col("of").alias("seg"), "key", "id", "dl", "part")

    def documents(self, state: State | None = None) -> DataFrame:
        """``seg, key, id, dl, part`` of the documents alive."""
        state = state or self.state()
        docs = self._table("docs", DOCS, state.segments)
        return docs.join(self._dead(state), ["seg", "key", "id"], "left_anti") if state.gone else docs

    # upkeep

    def _figures(self, rows: DataFrame, name: str, sign: int) -> None:
        sums = rows.groupBy("key").agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.sum("dl")).alias("total"))
        sums.write.parquet(f"{self.folder}/figures/seg={name}")

    def _segment(self, docs: DataFrame, hits: DataFrame | None = None) -> str:
        """Writes documents (``key, id, dl, words``, the words joined by spaces) and their postings. Words may come apart as ``hits`` (``key, id, term, tf``).

        Texts are sorted once; a task makes the postings of whole parts, so that only these rows move again.
        """
        name = f"s{uuid.uuid4().hex[:12]}"
        if hits is not None:
            apart = F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int"))))
            docs = docs.join(hits.groupBy("key", "id").agg(F.array_join(apart, " ").alias("words")), ["key", "id"], "left")
        place = F.shiftright(F.monotonically_increasing_id(), PART_BITS)
        placed = docs.select("key", "id", "dl", F.coalesce("words", F.lit("")).alias("words")).orderBy("key", "dl", "id").withColumn("part", place)
        rows = placed.mapInArrow(_postings, MADE)
        # a part's documents are the entries of no term
        self._write_postings(rows.withColumn("bucket", F.coalesce(self._bucket(F.col("term")), F.lit(-1))).hint("rebalance", F.col("bucket")), name)
        listed = self._table("postings", POSTINGS, [name]).where("bucket = -1").select("key", "part", F.inline("entries"))
        listed.select("key", "id", "dl", "part").write.parquet(f"{self.folder}/docs/seg={name}")
        kept = self._table("docs", DOCS, [name])
        if kept.groupBy("key", "id").count().where("count > 1").limit(1).count():
            raise ValueError("ids are not unique within their key")
        self._figures(kept, name, 1)
        return name

    def _write_postings(self, rows: DataFrame, name: str) -> None:
        """Figures of a row's entries are taken where it is written, not carried there."""
        most, least = F.array_max(F.transform("entries", lambda e: e["tf"])), F.array_min(F.transform("entries", lambda e: e["dl"]))
        rows = rows.sortWithinPartitions("bucket", "term", "key", "part")
        rows.select("term", "key", "part", F.size("entries").cast("long").alias("n"), most.alias("most"), least.alias("least"), "entries", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/postings/seg={name}")

    def _joined(self, state: State) -> str:
        """Writes the living documents and postings of all segments as one segment. Parts stay together, and those that follow by length fill up to PART documents or
        a part more; postings are never taken apart into rows."""
        name = f"s{uuid.uuid4().hex[:12]}"
        alive, on = self.documents(state), ["seg", "key", "part"]
        sizes = alive.groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.min("dl").alias("least"))
        before = F.sum("n").over(Window.partitionBy("key").orderBy("least", "seg", "part").rowsBetween(Window.unboundedPreceding, -1))
        parts = sizes.select(*on, F.shiftright(F.coalesce(before, F.lit(0)), PART_BITS).alias("to"))
        alive.join(parts, on).select("key", "id", "dl", F.col("to").alias("part")).write.parquet(f"{self.folder}/docs/seg={name}")
        self._figures(self._table("docs", DOCS, [name]), name, 1)
        dead = self._dead(state).groupBy(on).agg(F.collect_set("id").alias("dead"))
        known = parts.join(dead, on, "left") if state.gone else parts.withColumn("dead", F.lit(None).cast("array<string>"))
        left = F.when(F.col("dead").isNull(), F.col("entries")).otherwise(F.filter("entries", lambda e: ~F.array_contains("dead", e["id"])))
        rows = self._table("postings", POSTINGS, state.segments).where("bucket >= 0").join(known, on).select("bucket", "term", "key", F.col("to").alias("part"), left.alias("entries")).where("size(entries) > 0")
        # a term's rows meet where they are written
        rows = rows.withColumn("share", F.pmod(F.xxhash64("term"), F.lit(SHARES))).repartition("bucket", "share").groupBy("bucket", "share", "term", "key", "part").agg(F.flatten(F.collect_list("entries")).alias("entries"))
        self._write_postings(rows, name)
        return name

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")

    def _bury(self, state: State, gone: DataFrame) -> str | None:
        """Tombstones for the living documents that ``gone`` (``key``, and ``id`` or not) names."""
        if not state.segments:
            return None
        name = f"s{uuid.uuid4().hex[:12]}"
        on = [c for c in ("key", "id") if c in gone.columns]
        self.documents(state).join(gone.select(on).distinct(), on, "left_semi").select("key", "id", "dl", "part", F.col("seg").alias("of")).write.parquet(f"{self.folder}/gone/seg={name}")
        rows = self._table("gone", GONE, [name])
        if not rows.limit(1).count():
            return None
        self._figures(rows, name, -1)
        return name

    def add(self, docs: DataFrame, key_col: str = "project_id", id_col: str = "paper_id", text_col: str = "full_text") -> None:
        """Adds documents, in the place of those of the same key and id. Null texts are empty, null keys the empty one; rows without an id are left out."""
        state = self.state()
        read = docs.select(F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("key"), F.col(id_col).cast("string").alias("id"), text.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).where("id IS NOT NULL")
        name = self._segment(read.select("key", "id", F.size("words").cast("long").alias("dl"), F.array_join("words", " ").alias("words")))
        self._commit(state, name, self._bury(state, self._table("docs", DOCS, [name])), [])

    def delete(self, gone: DataFrame) -> None:
        """Deletes the documents of the keys, or keys and ids, of ``gone`` (``key``, and ``id`` or not)."""
        state = self.state()
        name = self._bury(state, gone)
        if name:
            self._commit(state, None, name, [])

    def merge(self) -> None:
        """One segment of all that is alive."""
        state = self.state()
        if len(state.segments) + len(state.gone) < 2:
            return
        self._commit(state, self._joined(state), None, [*state.segments, *state.gone])

    # search

    def _pinned(self, rows: DataFrame, few: bool) -> DataFrame:
        """Rows as values where they are few (one scope's), else as the table they come from."""
        return self.spark.createDataFrame(rows.collect(), rows.schema) if few else rows

    def search(self, question: str, k: int, per_key: bool = False) -> DataFrame:
        """``key, id, score, rank`` of the ``k`` best documents by BM25, of all or of each key by its own figures.

        A word that the question repeats counts as often. Ties go to the smaller id. Of one scope, figures, bounds and threshold are a few values by then, and
        what is returned is one scan of the query's postings.
        """
        best = self.candidates(question, k, per_key)
        return lexical.top(best, k, "key") if per_key else lexical.top(best, k)

    def candidates(self, question: str, k: int, per_key: bool = False) -> DataFrame:
        """``key, id, score`` of all documents that score as high as the ``k``-th best, ties with it included, and of some others."""
        state, times = self.state(), Counter(lexical.query_words(question))
        scope, few = F.col("key") if per_key else F.lit(""), not per_key
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in times})
        rows = self._table("postings", POSTINGS, state.segments if times else [])
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(times))).withColumn("scope", scope)
        sums = self._table("figures", FIGURES, state.segments + state.gone).groupBy(scope.alias("scope")).agg(F.sum("n").alias("docs"), F.sum("total").alias("total"))
        corpus = sums.select("scope", "docs", (F.col("total") / F.greatest("docs", F.lit(1))).alias("mean"))
        count = rows.groupBy("scope", "term").agg(F.sum("n").alias("df"))
        if state.gone:
            near = rows.join(self._dead(state).select("seg", "key", "part").distinct(), ["seg", "key", "part"], "left_semi").select("scope", "term", "seg", "key", F.inline("entries"))
            lost = near.join(self._dead(state), ["seg", "key", "id"], "left_semi").groupBy("scope", "term").agg(F.count(F.lit(1)).alias("lost"))
            count = count.join(lost, ["scope", "term"], "left").select("scope", "term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
        often = F.create_map(*(F.lit(x) for pair in times.items() for x in pair))[F.col("term")] if times else F.lit(0)
        idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weights = self._pinned(count.join(corpus, "scope").select("scope", "term", (often * idf).alias("weight"), "mean"), few)
        bounded = rows.join(weights, ["scope", "term"]).withColumn("bound", _score("most", "least"))
        # of each scope the part with the largest sum of bounds
        sums = bounded.groupBy("scope", "seg", "key", "part").agg(F.sum("bound").alias("bound"))
        first = sums.groupBy("scope").agg(F.max(F.struct("bound", "seg", "key", "part")).alias("p")).select("scope", "p.seg", "p.key", "p.part")
        scored = self._scored(bounded.join(first, ["scope", "seg", "key", "part"]), state)
        place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score")))  # over one part a scope
        least = scored.withColumn("place", place).where(F.col("place") == k).select("scope", F.col("score").alias("threshold"))
        tops = bounded.groupBy("scope", "term").agg(F.max("bound").alias("top"))
        reach = self._pinned(tops.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("term", "top"))).alias("tops")).join(least, "scope", "left"), few)
        others = F.aggregate(F.map_values("tops"), F.lit(0.0), lambda a, x: a + x) - F.col("tops")[F.col("term")]
        # scores are rounded to six decimals
        able = bounded.join(reach, "scope").where(F.col("bound") + others + 2e-6 >= F.coalesce("threshold", F.lit(0.0)))
        return self._scored(able, state).drop("scope")

    def _scored(self, rows: DataFrame, state: State) -> DataFrame:
        """``scope, key, id, score`` of the living documents in ``rows``."""
        entries = rows.select("scope", "seg", "key", "weight", "mean", F.inline("entries"))
        if state.gone:
            entries = entries.join(self._dead(state).select("seg", "key", "id"), ["seg", "key", "id"], "left_anti")
        return entries.groupBy("scope", "key", "id").agg(F.round(F.sum(_score("tf", "dl")), 6).alias("score"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents in order (``key, id, dl, words, part``) the rows of each part: its documents without a term, then its terms."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        key, part = table["key"].combine_chunks().dictionary_encode().indices.to_numpy(), table["part"].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist()] if len(table) else [0]
        for start, end in zip(cuts, cuts[1:]):
            yield _of_part(table.slice(start, end - start))
        held = table.slice(cuts[-1])
    if held:
        yield _of_part(held)


def _of_part(docs: pa.Table) -> pa.RecordBatch:
    size, ids, lengths = len(docs), docs["id"].combine_chunks(), docs["dl"].to_numpy()
    words = pc.split_pattern(docs["words"].combine_chunks(), " ")
    owner, flat = np.repeat(np.arange(size), pc.list_value_length(words).to_numpy(zero_copy_only=False)), words.flatten()
    coded = flat.dictionary_encode()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    pairs, tf = np.unique((coded.indices.to_numpy().astype(np.int64) * size + owner)[full], return_counts=True)
    term, row = pairs // max(size, 1), pairs % max(size, 1)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    rows, offsets = np.concatenate([np.arange(size), row]), np.concatenate([[0], size + starts, [size + len(term)]])
    entry = pa.StructArray.from_arrays([ids.take(pa.array(rows)), pa.array(np.concatenate([np.zeros(size, np.int64), tf])), pa.array(lengths[rows])], ["id", "tf", "dl"])
    terms = pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(term[starts]))])
    key, part = (docs[c].combine_chunks().take(pa.array(np.zeros(len(terms), np.int64))) for c in ("key", "part"))
    return pa.RecordBatch.from_arrays([terms, key, part, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entry)], ["term", "key", "part", "entries"])


def _score(tf: str, dl: str) -> Column:
    """A word's part of the score, by frequency and length; null where no document is left."""
    n = F.col(tf)
    return F.col("weight") * n * (K1 + 1) / (n + K1 * (1 - B + B * F.try_divide(F.col(dl), F.col("mean"))))
