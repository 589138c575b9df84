"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

The n-grams have one global order: first those in few documents, then by hash. The join cuts this order into ``FRAGMENTS`` and so every
document's set into segments. What two documents share is counted in each fragment by itself, and the partial counts are summed per pair.

*Sets* (``shared_sets``). Batches of documents send their n-grams, as arrays for each range of hashes, to the task that counts in how many
documents each n-gram is, and get back those of two documents or more. An n-gram of many documents of a batch is sent once, with their
number, so that no task gets a row for each document that has a frequent one. A document of which over a fifth (at
80 percent) is in no other document has no partner and goes no further; nothing of it is kept but its size.

*Candidates* (``components``). Two similar documents share one of the first n-grams of each (prefix filtering), the rarest. Only
components are wanted, so there are two goes. First every document is compared with one other, the hub of most of its cells: that joins
most of a group of copies, in one pair for each document. Then cells that still hold more than one component are gone through, all of
them and whatever their size: documents are put into blocks of about ``BLOCK`` n-grams, near ones together, and two blocks that
share a cell are compared whole, fragment by fragment, in matrices. A group of many documents close to the
threshold costs pairs of blocks, not rows of pairs, and no link across components is lost.

An n-gram stands for itself by 64 bits of XXH64, and a set by 128 bits of BLAKE2b over these.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, portions, release, slices, utf8
from .components import connected_components
from .simhash import bits_of

FRAGMENTS = 4
#: N-grams of a block of documents, about.
BLOCK = 1 << 16
#: Bytes of text whose n-grams are sent together, and that one counting task has to count, about.
BATCH_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
#: An n-gram of more documents of a batch is sent once, with their number.
OFTEN = 16
#: Bytes of a text taken apart at a time.
PART = 1 << 20

#: Places in a batch (of at most 1024 rows) are below this; above it are numbers of documents.
_MARK = 1 << 15
_MOST = (1 << 15) - 1
_SPACE = re.compile(rb"[ \t-\r]")
_FIELDS = "batch long, docs binary, tokens binary, counts binary, ids array<{0}>, sizes binary, digests binary, prints binary"


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted different hashes of the ``width``-word shingles. Words are between ASCII white space, A-Z lower-cased; fewer words give one shingle of them all."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    found, words, start = [], [], 0
    while start < len(text):
        cut = _SPACE.search(text, start + PART)
        stop = cut.start() if cut else len(text)
        words += text[start:stop].lower().split()
        found.append(np.array([digest(join(s), seed) for s in zip(*(words[i:] for i in range(width)))], dtype=np.uint64))
        if start or cut:
            words = words[-(width - 1) :] if width > 1 else []
        start = stop
    if any(map(len, found)):
        return np.unique(np.concatenate(found))
    return np.array([digest(join(words), seed)] if words else [], dtype=np.uint64)


def needed(n: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """How many of ``n`` n-grams must be in the other set too, in whole numbers."""
    if isinstance(n, np.ndarray):
        return (percent * n + 99) // 100
    return F.floor((n * percent + 99) / 100)


def _stepped(docs: np.ndarray) -> np.ndarray:
    """Sorted places as steps from one to the next, mostly 0 or 1, which compresses well; numbers of documents stay."""
    plain = docs[docs < _MARK]
    return np.concatenate([np.diff(plain, prepend=np.uint16(0)), docs[len(plain) :]])


def _placed(steps: np.ndarray) -> np.ndarray:
    plain = steps[steps < _MARK]
    return np.concatenate([np.cumsum(plain, dtype=np.uint16), steps[len(plain) :]])


def _sent(number: int, ids: pa.Array, sets: list[np.ndarray], prints: np.ndarray, ranges: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The n-grams of a batch by ranges, and a row with what the batch keeps."""
    tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
    docs = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    own, counts = np.unique(tokens, return_counts=True)
    often = counts > OFTEN
    held = np.repeat(often, counts)
    kept = tokens[held].tobytes(), docs[held].tobytes()
    tokens = np.concatenate([tokens[~held], own[often]])
    docs = np.concatenate([docs[~held], (counts[often] + _MARK).astype(np.uint16)])
    to = (tokens >> np.uint64(20)) % np.uint64(ranges)
    order = np.lexsort((docs, to))
    tokens, docs, to = tokens[order], docs[order], to[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    ends = [*first[1:].tolist(), len(to)]
    rows = [(int(to[a]), number, _stepped(docs[a:b]).tobytes(), tokens[a:b].tobytes()) for a, b in zip(first.tolist(), ends)]
    rows.append((number % ranges, number, kept[1], kept[0]))
    n = len(rows)
    none = pa.nulls(n - 1, pa.binary())
    last = [np.array([len(s) for s in sets], np.int64).tobytes(), b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), prints.tobytes()]
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.binary()) for i in range(4)]
    columns += [pa.nulls(n, pa.binary()), pa.concat_arrays([pa.nulls(n - 1, lists.type), lists])]
    columns += [pa.concat_arrays([none, pa.array([x], pa.binary())]) for x in last]
    yield pa.RecordBatch.from_arrays(columns, names)


def _counted(table: pa.Table) -> pa.Table:
    """Of a range of hashes, the n-grams of two documents or more, with the number of documents; rows of batches pass."""
    passing = table.column("ids").is_valid()
    own, rest = table.filter(passing), table.filter(pc.invert(passing))
    out = [own.drop_columns(["range"])]
    if len(rest):
        parts = [np.frombuffer(x, np.uint64) for x in rest.column("tokens").to_pylist()]
        ends = np.cumsum([len(x) for x in parts])
        docs = np.concatenate([_placed(np.frombuffer(x, np.uint16)) for x in rest.column("docs").to_pylist()])
        tokens, place = np.unique(np.concatenate(parts), return_inverse=True)
        weights = np.where(docs >= _MARK, docs.astype(np.int64) - _MARK, 1)
        count = np.bincount(place, weights=weights, minlength=len(tokens)).astype(np.int64)[place]
        kept, count = count >= 2, np.minimum(count, _MOST).astype(np.uint16)
        rows = []
        for batch, part, end in zip(rest.column("batch").to_pylist(), parts, ends.tolist()):
            at = slice(end - len(part), end)
            chosen = kept[at]
            if chosen.any():
                rows.append((batch, docs[at][chosen].tobytes(), part[chosen].tobytes(), count[at][chosen].tobytes()))
        made = [pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(4)]
        blank = [pa.nulls(len(rows), own.schema.field(name).type) for name in ("ids", "sizes", "digests", "prints")]
        out.append(pa.Table.from_arrays(made + blank, schema=out[0].schema))
    return pa.concat_tables(out)


def _assembled(table: pa.Table, percent: int) -> pa.Table:
    """A row for each document of a batch; its shared n-grams in global order if it can have a partner."""
    passing = table.column("ids").is_valid()
    own, rest = table.filter(passing).combine_chunks(), table.filter(pc.invert(passing))
    ids = own.column("ids").chunk(0).flatten()
    sizes = np.frombuffer(own.column("sizes")[0].as_py(), np.int64)
    digests, prints = own.column("digests")[0].as_py(), np.frombuffer(own.column("prints")[0].as_py(), np.int64)
    docs, tokens, counts = (np.frombuffer(b"".join(rest.column(c).to_pylist()), kind) for c, kind in (("docs", np.uint16), ("tokens", np.uint64), ("counts", np.uint16)))
    marks = docs >= _MARK
    held, held_docs = np.frombuffer(own.column("tokens")[0].as_py(), np.uint64), np.frombuffer(own.column("docs")[0].as_py(), np.uint16)
    named = np.argsort(tokens[marks])
    held_counts = counts[marks][named][np.searchsorted(tokens[marks][named], held)] if len(held) else np.zeros(0, np.uint16)
    docs, tokens, counts = (np.concatenate([x[~marks], y]) for x, y in ((docs, held_docs), (tokens, held), (counts, held_counts)))
    codes = (counts.astype(np.uint64) << np.uint64(48)) | (tokens >> np.uint64(16))
    shared = np.bincount(docs, minlength=len(sizes))
    rare = sizes - shared
    able = (sizes > 0) & (rare <= sizes - needed(sizes, percent))
    chosen = able[docs]
    docs, tokens, codes = docs[chosen], tokens[chosen], codes[chosen]
    order = np.lexsort((tokens, codes, docs))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.where(able, shared, 0))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].view(np.int64))) for x in (tokens, codes)]
    fps = pa.array([digests[16 * i : 16 * i + 16] for i in range(len(sizes))], pa.binary())
    columns = [ids, pa.array(sizes), fps, pa.array(prints), pa.array(rare), pa.array(able), *lists]
    return pa.Table.from_arrays(columns, ["id", "n", "fp", "print", "rare", "able", "tokens", "codes"])


def shared_sets(docs: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch, width: int = 5, seed: int = 42, prints: bool = False) -> DataFrame:
    """``row, id, n, fp, print, rare, able, tokens, codes`` of each row of ``docs``, written.

    ``n`` is the size of its set, ``fp`` a digest of it, ``print`` its SimHash if ``prints``, ``rare`` how many n-grams are in no other
    document, ``able`` whether so few that it can have a partner; if so, ``tokens`` are the others in global order, and ``codes`` what the order goes by first.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    kind = read.schema["id"].dataType.simpleString()
    fields = _FIELDS.format(kind)
    names = ["range", *(f.split()[0] for f in fields.split(", "))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            texts = utf8(batch.column(1))
            for start, stop in portions(texts, BATCH_BYTES):
                sets = [shingles(t or b"", width, seed) for t in texts[start:stop]]
                own = np.array([bits_of(s) if prints else 0 for s in sets], dtype=np.uint64)
                yield from _sent(number, batch.column(0).slice(start, stop - start), sets, own, ranges, names)
                number += 1

    found = read.mapInArrow(send, f"range long, {fields}").groupBy("range").applyInArrow(_counted, fields)
    schema = f"id {kind}, n long, fp binary, print long, rare long, able boolean, tokens array<long>, codes array<long>"
    rows = found.groupBy("batch").applyInArrow(lambda table: _assembled(table, percent), schema)
    return scratch.save(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")


def nodes_of(rows: DataFrame, scratch: Scratch, low: Column) -> DataFrame:
    """``node, fp, low, n, print, m, p, tokens, codes``: the different sets that can have a partner. ``node`` is the first row, ``m`` the number
    of ``tokens``, of which the first ``p`` are of the prefix; ``low`` aggregates the rows of the set."""
    able = rows.where("able")
    first = scratch.save(able.groupBy("fp").agg(F.min("row").alias("row"), low.alias("low")), "first")
    met = able.join(first.drop("fp"), "row")
    return scratch.save(met.select(F.col("row").alias("node"), "fp", "low", "n", "print", F.size("tokens").alias("m"), "rare", "tokens", "codes"), "nodes")


def _fitting(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes ``a`` and ``b`` can be so similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def segments(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, n, m, fragment, segment``: the sets cut at quantiles of all their n-grams in global order."""
    shares = [i / FRAGMENTS for i in range(1, FRAGMENTS)]
    cuts = nodes.select(F.explode("codes").alias("code")).agg(F.percentile_approx("code", F.array(*map(F.lit, shares)), F.lit(1000))).first()[0] or []
    ends = [F.lit(0), *(F.size(F.filter("codes", lambda c, cut=cut: c < cut)) for cut in cuts), F.size("codes")]
    cut = F.array(*(F.struct(F.lit(i).alias("fragment"), F.slice("tokens", a + 1, b - a).alias("segment")) for i, (a, b) in enumerate(zip(ends, ends[1:]))))
    each = nodes.select("node", "n", "m", F.explode(cut).alias("s")).select("node", "n", "m", "s.fragment", "s.segment")
    return scratch.save(each.where(F.size("segment") > 0), "segments")


def linked(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """``u, v``: the pairs that are similar enough, by partial counts in each fragment."""
    a, b = (cut.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), "fragment", F.col("segment").alias(f"segment_{x}")) for x in "uv")
    met = pairs.select("u", "v").join(a, "u").join(b, ["v", "fragment"])
    counts = met.select("u", "v", "n_u", "n_v", F.size(F.array_intersect("segment_u", "segment_v")).alias("part")).groupBy("u", "v", "n_u", "n_v").agg(F.sum("part").alias("common"))
    return counts.where(F.col("common") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("common")) * percent).select("u", "v")


def _cells(nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``cell, node, n, m, members``: the prefix n-grams that several sets have."""
    prefix = (F.col("n") - needed(F.col("n"), percent) + 1 - F.col("rare")).cast("int")
    cells = nodes.select("node", "n", "m", F.explode(F.slice("tokens", F.lit(1), prefix)).alias("cell"))
    several = scratch.save(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "several")
    return scratch.save(cells.join(several, "cell"), "cells")


def _hubs(cells: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``u, v``: each set with the hub of most of its cells. A cell's hub is its set with most cells, of equal ones the first."""
    degree = scratch.save(cells.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degree")
    hub = scratch.save(cells.join(degree, "node").groupBy("cell").agg(F.min(F.struct((-F.col("degree")).alias("less"), "node", "n")).alias("hub")), "hubs")
    met = cells.join(hub, "cell").select("node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    met = met.where("node <> hub").where(_fitting("n", "hub_n", percent)).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("node").agg(F.min(F.struct((-F.col("times")).alias("less"), "hub")).alias("best"))
    return best.select(F.col("node").alias("u"), F.col("best.hub").alias("v"))


def _blocks(mixed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``node, label, block, step``: where each set of ``mixed`` goes. Sets of a component are together, of others those with one largest cell;
    blocks hold sets of one step of size."""
    home = mixed.groupBy("node", "n", "m", "label").agg(F.max(F.struct("members", "cell")).alias("home"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) + 1e-9))
    near = F.when(F.col("label").isNotNull(), F.xxhash64(F.lit("component"), "label")).otherwise(F.xxhash64(F.lit("cell"), "home.cell"))
    home = scratch.save(home.select("node", "m", F.coalesce("label", "node").alias("label"), step.alias("step"), near.alias("near")), "home")
    parts = home.groupBy("near", "step").agg(F.ceil(F.sum("m") / BLOCK).alias("parts"))
    split = home.join(scratch.save(parts, "parts"), ["near", "step"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    split = scratch.save(split, "split")
    named = scratch.save(split.select("near", "step", "part").distinct().withColumn("block", F.monotonically_increasing_id()), "named")
    return scratch.save(split.join(named, ["near", "step", "part"]).select("node", "label", "block", "step"), "blocks")


def _meetings(mixed: DataFrame, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: blocks with a cell in common and different components in it; ``a`` may be ``b``."""
    met = mixed.select("cell", "node").join(blocks, "node").groupBy("cell", "block", "step").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    met = scratch.save(met, "met")
    a, b = (met.select("cell", F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("step", "low", "high"))) for x in "ab")
    pairs = a.join(b, "cell").where("a <= b").where(F.abs(F.col("step_a") - F.col("step_b")) <= 1)
    return scratch.save(pairs.where(F.least("low_a", "low_b") < F.greatest("high_a", "high_b")).select("a", "b").distinct(), "meetings")


def _incidence(lists: pa.ListArray, vocabulary: np.ndarray) -> np.ndarray:
    values = lists.values.to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy(zero_copy_only=False)
    values, owner = values[ends[0] : ends[-1]], np.repeat(np.arange(len(lists)), np.diff(ends))
    at = np.searchsorted(vocabulary, values)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == values
    out = np.zeros((len(lists), len(vocabulary)), dtype=np.float32)
    out[owner[known], at[known]] = 1
    return out


def _partial(a: pa.StructArray, b: pa.StructArray, percent: int) -> tuple[np.ndarray, ...]:
    """``u, v, common, least`` of the pairs that a fragment leaves possible: ends, n-grams in common here, how many they need in all."""
    left, right = (dict(zip(("node", "label", "n", "m"), (x.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "m")))) for x in (a, b))
    parts = [x.field("segment") for x in (a, b)]
    both = np.intersect1d(*(p.values.to_numpy(zero_copy_only=False)[p.offsets[0].as_py() : p.offsets[len(p)].as_py()] for p in parts))
    if not len(both):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    common = (_incidence(parts[0], both) @ _incidence(parts[1], both).T).astype(np.int64)
    lengths = [np.diff(p.offsets.to_numpy(zero_copy_only=False)) for p in parts]
    least = -((-percent * (left["n"][:, None] + right["n"][None, :])) // (100 + percent))
    elsewhere = np.minimum((left["m"] - lengths[0])[:, None], (right["m"] - lengths[1])[None, :])
    i, j = np.nonzero((common > 0) & (common + elsewhere >= least) & (left["label"][:, None] != right["label"][None, :]))
    return left["node"][i], right["node"][j], common[i, j], least[i, j]


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Some of the links, of the same components."""
    at: dict[int, int] = {}

    def top(x: int) -> int:
        while at.setdefault(x, x) != x:
            at[x] = x = at[at[x]]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist()):
        a, b = top(x), top(y)
        if a != b:
            at[a] = b
            out.append((x, y))
    return out


def _summed(table: pa.Table) -> pa.Table:
    """Links of two blocks: partial counts of the fragments summed per pair."""
    u, v, common, least = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("u", "v", "common", "least"))
    order = np.lexsort((v, u))
    u, v, common, least = u[order], v[order], common[order], least[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, np.int64)
    enough = (np.add.reduceat(common, first) if len(u) else common) >= least[first]
    rows = _forest(u[first][enough], v[first][enough])
    return pa.table({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})


def across(cells: DataFrame, labels: DataFrame, cut: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``u, v``: links that join all components of ``labels`` (``node, label``) that any link joins."""
    known = cells.join(labels.select("node", "label"), "node", "left")
    several = known.groupBy("cell").agg(F.min(F.coalesce("label", "node")).alias("a"), F.max(F.coalesce("label", "node")).alias("b")).where("a < b").select("cell")
    mixed = scratch.save(known.join(scratch.save(several, "mixed-cells"), "cell"), "mixed")
    blocks = _blocks(mixed, percent, scratch)
    pairs = _meetings(mixed, blocks, scratch)
    one = F.struct("node", "label", "n", "m", "segment")
    packed = scratch.save(cut.join(blocks, "node").groupBy("block", "fragment").agg(F.collect_list(one).alias("sets")), "packed")
    a, b = (packed.select(F.col("block").alias(x), "fragment", F.col("sets").alias(f"sets_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            done = [_partial(batch.column(2)[i].values, batch.column(3)[i].values, percent) for i in range(batch.num_rows)]
            columns = [pa.array([np.ascontiguousarray(d[k], np.int64).tobytes() for d in done], pa.binary()) for k in range(4)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "u", "v", "common", "least"])
            yield out.filter(pa.array([len(d[0]) > 0 for d in done], pa.bool_()))

    met = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "sets_a", "sets_b")
    parts = met.mapInArrow(run, "a long, b long, u binary, v binary, common binary, least binary")
    return parts.groupBy("a", "b").applyInArrow(_summed, "u long, v long")


def components(nodes: DataFrame, percent: int, scratch: Scratch, first: DataFrame | None = None) -> DataFrame:
    """``node, label``: the component of each set of ``nodes`` that has company. ``first`` are pairs to try at once."""
    cut = segments(nodes, scratch)
    cells = _cells(nodes, percent, scratch)
    pairs = _hubs(cells, percent, scratch)
    pairs = scratch.save((pairs.union(first.select("u", "v")) if first is not None else pairs).distinct(), "tried")
    labels = connected_components(scratch.save(linked(pairs, cut, percent), "links"), scratch)
    scratch.only(nodes, cells, cut, labels)
    links = across(cells, labels, cut, percent, scratch)
    known = labels.select("node", "label")
    ends = [known.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "uv"]
    met = links.join(ends[0], "u", "left").join(ends[1], "v", "left").select(F.coalesce("label_u", "u").alias("u"), F.coalesce("label_v", "v").alias("v"))
    higher = connected_components(scratch.save(met, "across"), scratch).select(F.col("node").alias("label"), F.col("label").alias("top"))
    every = nodes.select("node").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return scratch.save(every.join(higher, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "components")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, seed: int = 42) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, the smallest id reachable over pairs of Jaccard similarity ``percent`` or more.

    Defined cases: null texts and texts without words have the empty set and are linked with nothing; fewer words than ``width`` are
    one n-gram; rows that repeat in id or text are linked like any others; null ids are never the smallest (a component of null ids only has a
    null one); an empty table gives an empty result; other columns are not read. Of a long text one part at a time is taken apart.
    """
    scratch, steps = Scratch(docs.sparkSession, "ngrams"), Scratch(docs.sparkSession, "ngrams-steps")
    rows = shared_sets(docs, id_col, text_col, percent, scratch, width, seed)
    nodes = nodes_of(rows, steps, F.min("id"))
    labels = components(nodes, percent, steps)
    named = steps.save(nodes.select("node", "fp", "low").join(labels, "node"), "named")
    lows = steps.save(named.groupBy("label").agg(F.min("low").alias("component_id")), "lows")
    known = scratch.save(named.join(lows, "label").select("fp", "component_id"), "known")
    steps.only()
    able = rows.where("able").join(known, "fp").select("id", "n", "component_id")
    out = able.union(rows.where("NOT able").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
