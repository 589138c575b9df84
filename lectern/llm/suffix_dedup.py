"""Removal of repeated passages by a distributed difference-cover suffix sort.

Texts are cut at anchors, places where a hash of the next ``GRAM`` bytes is in the smallest of ``RATE`` equal parts: what
repeats in two places is cut alike in both. Where an anchor's bytes are unique in the corpus nothing repeats, so only what lies
between such anchors is sorted. There, the phrases between anchors are the letters of much shorter strings:

- triples of phrases at positions 1 and 2 modulo 3 are sorted and named by rank,
- names are recursed upon (triples of names) until they reach over as many phrases as a passage has as a rule,
- the remaining positions are merged by their first phrases and the rank that follows them, ties by the phrases themselves,
- adjacent suffixes are compared: how many phrases they share says which windows can repeat at all.

A check of whole windows follows. Windows that begin and end in the same gaps between anchors are one cell; cells with equal
bytes repeat as a whole, and of the others only those that share all inner phrases are compared window by window.
Rolling hashes of 64 bits only choose what is compared, where a collision costs work; cells and windows are held equal by
128 bits of BLAKE2b over their bytes, so that texts built to collide lose nothing. Rows are told apart by id and SHA-256: their
64-bit keys are checked for clashes first, and pairs that clash get other ones.

Anchors, cells and windows are counted in packs: what a task finds goes to the bucket of its hash as one row of many entries,
and what a bucket chooses comes back to the documents in the same way. A hash is sent once by a batch, however often it is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PORTION, Scratch, portions, release, slices

GRAM = 32
#: The share of places that are anchors is one in RATE, or in an eighth of a shorter length: a window holds about seven.
RATE = 48
FAR = 1 << 20
#: Ranges of bytes that are digested at a time.
BLOCK = 1 << 14
#: Names that ranks reach over; what is equal so far is told apart by its names themselves when suffixes are sorted.
DEPTH = 9
#: Entries that wait to be packed, that a bucket counts as a rule, and documents that get theirs back together.
PACK, BUCKET, GROUP = 1 << 17, 1 << 19, 1 << 11
#: The least number of buckets and groups.
LEAST = 16
#: Hashes that rows' keys may take until no two differ and agree.
KEY_ROUNDS = 8

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_powers[0]) < n:
        size = max(n, PORTION + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, base, dtype=_U)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=_U)
    return _powers[0], _powers[1]


def _rate(length: int) -> int:
    return max(2, min(RATE, length // 8))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Rolling:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, data: bytes):
        octets = np.frombuffer(data, np.uint8)
        self.n = len(octets)
        powers, self.inverse = _power_tables(self.n + 1)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_VALUES[octets] * powers[: self.n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors for windows of ``length`` bytes, and the hashes of their bytes."""
        if self.n < GRAM:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        found = _mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: self.n - GRAM + 1])
        at = np.flatnonzero(found < _U(2**64 // _rate(length)))
        return at, found[at]


def _digests(text: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each range of ``text``, as two longs a row."""
    out = np.empty((len(start), 2), np.int64)
    for at in range(0, len(start), BLOCK):
        ranges = zip(start[at : at + BLOCK].tolist(), stop[at : at + BLOCK].tolist())
        made = b"".join([hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in ranges])
        out[at : at + BLOCK] = np.frombuffer(made, np.int64).reshape(-1, 2)
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(column: pa.Array) -> Iterator[np.ndarray | dict[str, np.ndarray]]:
    """The lists of a column as arrays, those of structs as an array for each field; null as empty."""
    starts, sizes, values = column.offsets.to_numpy()[:-1], column.value_lengths().fill_null(0).to_numpy(), column.values
    if pa.types.is_struct(values.type):
        fields = {values.type.field(i).name: values.field(i).to_numpy(zero_copy_only=False) for i in range(values.type.num_fields)}
        return ({n: f[a : a + m] for n, f in fields.items()} for a, m in zip(starts.tolist(), sizes.tolist()))
    flat = values.to_numpy(zero_copy_only=False)
    return (flat[a : a + m] for a, m in zip(starts.tolist(), sizes.tolist()))


def _flat(column: pa.Array, *fields: str) -> tuple[list[np.ndarray], ...]:
    """For each field of a column of lists of structs: the lists' arrays."""
    starts, sizes = column.offsets.to_numpy()[:-1].tolist(), column.value_lengths().fill_null(0).to_numpy().tolist()
    flat = [column.values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    return tuple([x[a : a + m] for a, m in zip(starts, sizes)] for x in flat)


def _spread(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a column of lists: their rows, their places in the lists, how many follow there, and themselves; null as empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, sizes[row] - place - 1, column.flatten().to_numpy(zero_copy_only=False)


def _ahead(values: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """For each entry the one ``step`` places on in its list; 0 where there is none."""
    out = np.zeros(len(values), np.int64)
    there = np.flatnonzero(left >= step)
    out[there] = values[there + step]
    return out


def _packs(rows: np.ndarray, part: np.ndarray, sure: bool) -> pa.RecordBatch:
    """Entries, the columns of ``rows``, as one row for each part."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[:, order], part[order]
    at = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0])[: len(part)])
    bodies = [rows[:, a:b].tobytes() for a, b in zip(at, [*at[1:], len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int64()), pa.array([sure] * len(at), pa.bool_()), pa.array(bodies, pa.binary())], ["part", "sure", "body"])


def _unpacked(packs: pa.Table, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(body, np.int64).reshape(width, -1) for body in packs["body"].to_pylist()], axis=1)


def _same(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of each different key (a column of ``keys``), and for each entry which of them it has."""
    order = np.lexsort(keys)
    new = np.concatenate([[True], (np.diff(keys[:, order]) != 0).any(axis=0)])[: len(order)]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


PACKS = "part long, sure boolean, body binary"


def _to_buckets(run: Callable, keys: int, buckets: int, groups: int, lone: bool = False):
    """Packs of what ``run`` yields: longs ``k``, how often, the ``keys``, and what else is known of an entry.

    A key's first entry stands for all of one packing, with their sum. The others are known to repeat: they go to
    their documents' group at once (``sure``), or nowhere where ``lone`` ones are looked for. So do entries that count 0, which
    are decided already.
    """

    def packed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        counted = np.flatnonzero(rows[1] > 0)
        first, kind = _same(rows[2 : 2 + keys, counted])
        first, total = counted[first], np.bincount(kind, rows[1, counted], len(first))
        rest = np.ones(rows.shape[1], dtype=bool)
        rest[first] = False
        if rest.any() and not lone:
            yield _packs(np.delete(rows[:, rest], slice(1, 2 + keys), axis=0), rows[0, rest] % groups, True)
        rows[1, first] = total.astype(np.int64)
        yield _packs(rows[:, first], (_mixed(rows[1 + keys, first].view(_U)) % _U(buckets)).astype(np.int64), False)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in run(batches):
            waiting.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size >= PACK:
                yield from packed(np.concatenate(waiting, axis=1))
                waiting, size = [], 0
        if size:
            yield from packed(np.concatenate(waiting, axis=1))

    return out


def _chosen(width: int, keys: int, groups: int, lone: bool = False):
    """Of a bucket's entries those whose key repeats, or those whose key does not, to their documents' groups."""

    def run(packs: pa.Table) -> pa.Table:
        rows = _unpacked(packs, width)
        _, kind = _same(rows[2 : 2 + keys])
        take = (np.bincount(kind, rows[1])[kind] > 1) != lone
        rows = np.delete(rows[:, take], slice(1, 2 + keys), axis=0)
        return pa.Table.from_batches([_packs(rows, rows[0] % groups, True)])

    return run


def _by_document(fields: list[str]):
    """The entries of a group of documents as one list for each, by the first field."""

    def run(packs: pa.Table) -> pa.Table:
        rows = _unpacked(packs, 1 + len(fields))
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        at = np.flatnonzero(np.concatenate([[True], np.diff(rows[0]) != 0])[: rows.shape[1]])
        values = pa.StructArray.from_arrays([pa.array(r) for r in rows[1:]], fields) if len(fields) > 1 else pa.array(rows[1])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, rows.shape[1]), pa.int32()), values)
        return pa.Table.from_arrays([pa.array(rows[0, at]), lists], ["k", "entries"])

    return run


def _documents(packs: DataFrame, fields: list[str]) -> DataFrame:
    """``k, entries``: what buckets sent back, by document."""
    kind = "struct<" + ", ".join(f"{f}: bigint" for f in fields) + ">" if len(fields) > 1 else "bigint"
    return packs.groupBy("part").applyInArrow(_by_document(fields), f"k long, entries array<{kind}>")


def _to_groups(groups: int):
    """Packs of rows of longs for the groups of their first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(np.stack([c.to_numpy() for c in batch.columns]).astype(np.int64, copy=False))
            size += batch.num_rows
            if size >= PACK:
                rows, waiting, size = np.concatenate(waiting, axis=1), [], 0
                yield _packs(rows, rows[0] % groups, True)
        if size:
            rows = np.concatenate(waiting, axis=1)
            yield _packs(rows, rows[0] % groups, True)

    return run


def _collected(rows: DataFrame, fields: list[str], groups: int) -> DataFrame:
    """``k, entries``: the rows (``k`` and ``fields``, longs) of each ``k`` as a list, by the first field."""
    return _documents(rows.select("k", *fields).mapInArrow(_to_groups(groups), PACKS), fields)


def _judged(packs: DataFrame, keys: int, fields: list[str], groups: int) -> DataFrame:
    """The packed entries whose key is there more than once, packed for their documents."""
    judged = packs.where("NOT sure").groupBy("part").applyInArrow(_chosen(2 + keys + len(fields), keys, groups), PACKS)
    return judged.unionByName(packs.where("sure"))


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 2048):
            texts = batch.column(1).to_pylist()
            for low, high in portions(texts):
                part = texts[low:high]
                ends = np.cumsum([0, *map(len, part)])
                at, found = Rolling(b"".join(part)).anchors(length)
                row = np.searchsorted(ends, at, "right") - 1
                ok = (at + GRAM <= ends[row + 1]) & (ends[row + 1] - ends[row] >= length)
                row, at, found = row[ok], at[ok], found[ok]
                take = pa.array(row + low)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), _signed(found), pa.array(at - ends[row])], ["k", "c", "h", "at"])

    return run


def _alive_runs(length: int):
    """Documents with windows that hold no unique anchor: text, and the runs of such windows' starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 256):
            rows, lows, highs = [], [], []
            for row, (text, lone) in enumerate(zip(batch.column(1).to_pylist(), _lists(batch.column(2)))):
                if text is None or len(text) < length:
                    continue
                starts = len(text) - length + 1
                change = np.bincount(np.maximum(lone - (length - GRAM), 0), minlength=len(text) + 1) - np.bincount(lone + 1, minlength=len(text) + 1)
                low, high = _runs(np.cumsum(change[:starts]) == 0)
                if len(low):
                    rows.append(row), lows.append(low), highs.append(high)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in (lows, highs))], ["k", "text", "low", "high"])

    return run


def _regions(text: bytes, low: list[int], high: list[int], length: int) -> Iterator[tuple[int, int, Rolling, np.ndarray]]:
    """For each run of starts: its bytes' start and end, the document's hashes, and the anchors within."""
    rolling = Rolling(text)
    at, _ = rolling.anchors(length)
    for a, b in zip(low, high):
        stop = b + length - 1
        yield a, stop, rolling, at[(at >= a) & (at + GRAM <= stop)]


def _name_rows(length: int):
    """The phrases of each region as names, and how many of them a window that starts at an anchor can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            keys, starts, names, needs = [], [], [], []
            for key, text, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                for a, _, rolling, at in _regions(text, low, high, length):
                    if len(at) > 1:
                        keys.append(key), starts.append(a)
                        names.append(rolling.hashes(at[:-1], at[1:] + GRAM).view(np.int64))
                        needs.append((np.searchsorted(at, at[:-1] + length - GRAM, "right") - 1 - np.arange(len(at) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(names, pa.list_(pa.int64())), pa.array(needs, pa.list_(pa.int32()))], ["k", "s", "names", "needs"])

    return run


def _triple_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triples of names at positions 1 and 2 modulo 3."""
    for batch in slices(batches, 256):
        row, j, left, names = _spread(batch.column(1))
        some = j % 3 != 0
        columns = j, names, _ahead(names, left, 1), _ahead(names, left, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), *(pa.array(c[some]) for c in columns)], ["id", "j", "a", "b", "c"])


def _deeper_rows(step: int):
    """Triples of ranks, ``step`` entries apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            row, _, left, ranks = _spread(batch.column(1))
            columns = batch.column(2).flatten(), ranks, _ahead(ranks, left, step), _ahead(ranks, left, 2 * step)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, columns)], ["id", "j", "a", "b", "c"])

    return run


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each suffix under two of three keys, as any two kinds of places compare by one of them; ``o`` is the key's number and the begin of ``x``."""
    for batch in slices(batches, 64):
        row, j, left, names = _spread(batch.column(1))
        needs = _spread(batch.column(2))[3]
        *_, ranks = _spread(batch.column(3))
        many = batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begin = (np.cumsum(many) - many)[row]

        def rank(step: int) -> np.ndarray:
            at, out = (j + step) // 3 * 2 + (j + step) % 3 - 1, np.zeros(len(j), np.int64)
            there = (at >= 0) & (at < many[row])
            out[there] = ranks[(begin + at)[there]]
            return out

        zero, sizes = np.zeros(len(j), np.int64), np.minimum(needs, left + 1)
        keys = (2, names, rank(1), zero), (1, names, _ahead(names, left, 1), rank(2)), (0, rank(0), zero, zero)
        for tag, (other, x, y, z) in enumerate(keys):
            some = np.flatnonzero(j % 3 != other)
            ends = np.cumsum(sizes[some])
            within = np.arange(sizes[some].sum()) + np.repeat(some - ends + sizes[some], sizes[some])
            offsets = (np.concatenate([[0], ends]) * 8).astype(np.int32)
            prefix = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(names[within])])
            o = (x.view(_U) >> _U(2) | _U(tag << 62)).view(np.int64)
            longs = [pa.array(c[some]) for c in (o, x, y, z)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), tag, np.int32)), *longs, batch.column(0).take(pa.array(row[some])), pa.array(j[some].astype(np.int32)), prefix], ["tag", "o", "x", "y", "z", "id", "j", "prefix"])


def _ranked(rows: DataFrame, scratch: Scratch, columns: list[str]) -> DataFrame:
    """The different values of ``columns`` with a ``name`` that sorts as they do.

    After a range shuffle and a sort within partitions, the running id of partition and row is such a name.
    """
    sorted_ = rows.select(columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return scratch.save(sorted_.withColumn("name", F.monotonically_increasing_id() + 1), "names")


def sample_ranks(strings: DataFrame, scratch: Scratch, reach: int) -> DataFrame:
    """``strings`` (``id``, ``names``) with ``ranks``: the order of the suffixes at positions 1 and 2 modulo 3, in place order.

    Equal ranks mean that the suffixes share ``reach`` names at least, or to their ends.
    """
    kind, groups = "id long, j long, a long, b long, c long", max(LEAST, strings.count() // GROUP)
    rows, covered, stride, last = strings.select("id", "names").mapInArrow(_triple_rows, kind), 3, 2, None
    while True:
        rows = scratch.save(rows, "triples")
        ranked = _ranked(rows, scratch, ["a", "b", "c"])
        named = _collected(rows.join(ranked, ["a", "b", "c"]).withColumnRenamed("id", "k"), ["j", "name"], groups)
        level = scratch.save(named.select(F.col("k").alias("id"), F.col("entries.name").alias("ranks"), F.col("entries.j").alias("places")), "level")
        scratch.drop(rows)
        if last is not None:
            scratch.drop(last)
        last = level
        if covered >= reach or ranked.count() == level.agg(F.sum(F.size("ranks"))).first()[0]:
            return strings.join(level.select("id", "ranks"), "id", "left")
        # the name at place j + covered stands ``stride`` entries on, as two of three places are sampled
        rows, covered, stride = level.select("id", "ranks", "places").mapInArrow(_deeper_rows(stride), kind), covered * 3, stride * 3


def _adjacent(rows: pa.RecordBatch) -> np.ndarray:
    """How many names each sorted suffix but the last shares with the next one."""
    tag, prefix = rows["tag"].to_numpy(), rows["prefix"]
    if pa.types.is_list(prefix.type):
        starts, sizes, flat = prefix.offsets.to_numpy()[:-1], prefix.value_lengths().to_numpy(), prefix.values.to_numpy()
    else:  # eight bytes a name
        _, offsets, data = prefix.buffers()
        ends = np.frombuffer(offsets, np.int32)[prefix.offset : prefix.offset + len(prefix) + 1] // 8
        starts, sizes, flat = ends[:-1], np.diff(ends), np.frombuffer(data or b"", np.int64)
    shared = np.zeros(max(len(tag) - 1, 0), np.int32)
    left = np.flatnonzero(tag[1:] == tag[:-1])
    depth = 0
    while len(left):
        left = left[np.minimum(sizes[left], sizes[left + 1]) > depth]
        left = left[flat[starts[left] + depth] == flat[starts[left + 1] + depth]]
        shared[left] += 1
        depth += 1
    return shared


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many names each sorted suffix shares with the one before or after it. At the partition's ends: any number.

    A batch's last suffix waits for the next batch, so one batch is held at a time.
    """

    def known(rows: pa.RecordBatch, best: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows["id"], rows["j"], pa.array(best, pa.int32())], ["id", "j", "shared"])

    last, before = None, FAR
    for batch in batches:
        rows = batch if last is None else pa.concat_batches([last, batch])
        if rows.num_rows:
            shared = np.concatenate([[before], _adjacent(rows)])
            yield known(rows.slice(0, rows.num_rows - 1), np.maximum(shared[:-1], shared[1:]))
            last, before = rows.slice(rows.num_rows - 1), shared[-1]
    if last is not None:
        yield known(last, np.array([FAR]))


def shared_names(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, shared``: for each name of each string how many names its suffix shares with another one, if any, at least up to
    the entry of ``needs`` there. ``strings`` has ``id, names, needs, copies``."""
    reach = strings.agg(F.max(F.array_max("needs"))).first()[0] or 0
    ranked = sample_ranks(strings, scratch, min(reach, DEPTH))
    kind = "tag int, o long, x long, y long, z long, id long, j int, prefix binary"
    merged = scratch.save(ranked.select("id", "names", "needs", "ranks").mapInArrow(_suffix_rows, kind), "suffixes")
    order = ["o", "x", "y", "z", "prefix", "id", "j"]
    best = merged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared, "id long, j int, shared int")
    best = best.where("shared > 0").select(F.col("id").alias("k"), "j", "shared")
    best = scratch.save(_collected(best, ["j", "shared"], max(LEAST, strings.count() // GROUP)).toDF("id", "shared"), "shared")
    scratch.drop(merged)
    return best


def _cell_rows(length: int):
    """The cells of windows whose inner phrases another suffix shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            cols: list[list] = [[], [], [], [], [], [], []]
            known, sizes = batch.column(4).flatten(), batch.column(4).value_lengths().fill_null(0).to_numpy()
            string, places, counts = known.field("s").to_numpy(), *_flat(known.field("shared"), "j", "shared")
            ends = np.cumsum(sizes)
            for row, (key, text, low, high, copies) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)))):
                entry: dict[int, list[int]] = {}
                for i in range(ends[row] - sizes[row], ends[row]):
                    entry.setdefault(int(string[i]), []).append(i)
                for a, stop, rolling, at in _regions(text, low, high, length):
                    most = np.full(len(at) + 1, FAR if copies > 1 else 0)
                    for i in entry.get(a, ()):  # several if strings have one hash: what any of them shares is tried
                        place, count = places[i], counts[i]
                        ok = place < len(most)
                        np.maximum.at(most, place[ok], count[ok])
                    # a cell begins where a window loses its first anchor or wins a further one
                    lo = np.unique(np.concatenate([[a], at + 1, at - (length - GRAM)]))
                    lo = lo[(lo >= a) & (lo <= stop - length)]
                    hi = np.append(lo[1:] - 1, stop - length)
                    first, last = np.searchsorted(at, lo), np.searchsorted(at, lo + length - GRAM, "right") - 1
                    inner = last - first
                    ok = inner <= most[np.minimum(first, len(at))]
                    lo, hi, first, last, inner = lo[ok], hi[ok], first[ok], last[ok], inner[ok]
                    some, names = inner >= 0, np.zeros(len(lo), _U)
                    if some.any():
                        names[some] = rolling.hashes(at[first[some]], at[last[some]] + GRAM) | _U(1)
                    digests = _digests(text, lo, hi + length)
                    for col, x in zip(cols, (np.full(len(lo), key), np.full(len(lo), copies), names.view(np.int64), digests[:, 0], digests[:, 1], lo, hi)):
                        col.append(x)
            arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "c", "inner", "whole", "whole2", "lo", "hi"])

    return run


CELLS = f"{PACKS}, inner long, n long, k long, lo long, hi long"


def _cell_kinds(groups: int):
    """A bucket's cells that repeat as a whole, to their documents' groups; and the kinds of cells with one that stands for each."""
    choose = _chosen(7, 3, groups)

    def run(packs: pa.Table) -> pa.Table:
        rows, again = _unpacked(packs, 7), choose(packs)
        first, kind = _same(rows[2:5])
        n = np.bincount(kind, rows[1]).astype(np.int64)
        kinds = [pa.array(x) for x in (rows[2, first], n, rows[0, first], rows[5, first], rows[6, first])]
        none = [pa.nulls(again.num_rows, pa.int64())] * 5
        names = ["inner", "n", "k", "lo", "hi"]
        unpacked = [pa.nulls(len(first), f.type) for f in again.schema]
        return pa.concat_tables([pa.Table.from_arrays([*again.columns, *none], [*again.column_names, *names]), pa.Table.from_arrays([*unpacked, *kinds], [*again.column_names, *names])])

    return run


def _window_rows(length: int):
    """The different windows of the given cells, once for each document: how often it stands there ``n``, rolling hash ``h``, a place ``at``, and
    the place again as ``lo`` if it is the only one. Windows that a document itself repeats are decided by digest: their runs, from ``lo`` to ``at``, have ``n`` of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keys, texts, lists = batch.column(0).to_numpy(), batch.column(1).to_pylist(), list(_lists(batch.column(2)))
            for begin, end in portions(texts):
                text, ends = b"".join(texts[begin:end]), np.cumsum([0, *map(len, texts[begin:end])])
                row = np.repeat(np.arange(end - begin), [len(c["lo"]) for c in lists[begin:end]])
                lo, hi, n = (np.concatenate([c[f] for c in lists[begin:end]]) for f in ("lo", "hi", "n"))
                sizes = hi - lo + 1
                start = np.arange(sizes.sum()) + np.repeat(lo + ends[row] - np.cumsum(sizes) + sizes, sizes)
                times, doc = np.repeat(n, sizes), np.repeat(row, sizes)
                hashes = Rolling(text).hashes(start, start + length).view(np.int64)
                _, place = _same(np.stack([hashes, doc]))
                # several places with one hash in a text: only those with one digest are one window
                several = np.bincount(place)[place] > 1
                alone_at, several_at = np.flatnonzero(~several), np.flatnonzero(several)
                some, among = _same(np.stack([*_digests(text, start[several_at], start[several_at] + length).T, doc[several_at]]))
                first, kind = np.concatenate([alone_at, several_at[some]]), np.empty(len(start), np.int64)
                kind[alone_at], kind[several_at] = np.arange(len(alone_at)), len(alone_at) + among
                total = np.bincount(kind, times, len(first)).astype(np.int64)
                known = (total[kind] > 1) & (times == 1)
                flags = np.zeros(len(text) + 1, dtype=bool)
                flags[start[known]] = True
                low, high = _runs(flags)
                owner = np.searchsorted(ends, low, "right") - 1
                none, at = np.zeros(len(low), np.int64), start[first] - ends[doc[first]]
                key = keys[begin + np.concatenate([doc[first], owner])]
                made = (total, none), (hashes[first], none), (at, high - 1 - ends[owner]), (total, none), (np.where(total == 1, at, -1), low - ends[owner])
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.concatenate(x)) for x in made)], ["k", "c", "h", "at", "n", "lo"])

    return run


def _digest_rows(length: int):
    """Digests ``w, w2`` of the windows at the given places, with their ``n`` and ``lo``, which is ``hi`` too. Runs with ``n`` of 0 are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for key, text, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2))):
                at, n, lo = windows["at"], windows["n"], windows["lo"]
                digests, open_ = np.zeros((len(at), 2), np.int64), np.flatnonzero(n)
                digests[open_] = _digests(text, at[open_], at[open_] + length)
                for col, x in zip(cols, (np.full(len(at), key), n, digests[:, 0], digests[:, 1], lo, np.where(n > 0, lo, at))):
                    col.append(x)
            arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "n", "w", "w2", "lo", "hi"])

    return run


def _kept(length: int):
    """Removed bytes, their runs and the SHA-256 of the rest, from the runs of repeated windows' starts; those below 0 are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: list[list] = [[], [], []]
            spans: list[list] = []
            for text, runs in zip(batch.column(1).to_pylist(), _lists(batch.column(2))):
                some = runs["lo"] >= 0
                change = np.bincount(runs["lo"][some], minlength=len(text) + 1) - np.bincount(runs["hi"][some] + length, minlength=len(text) + 1)
                low, high = _runs(np.cumsum(change)[:-1] > 0)
                edges = [0, *np.stack([low, high], 1).ravel().tolist(), len(text)]
                rest = hashlib.sha256(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])).hexdigest()
                for col, x in zip(out, (int((high - low).sum()), len(low), rest)):
                    col.append(x)
                spans.append([{"start": a, "stop": b} for a, b in zip(low.tolist(), high.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(spans, kind)], ["k", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def _with_key(rows: DataFrame, moved: DataFrame | None) -> DataFrame:
    """``rows`` (with ``id`` and ``sha``) and ``k``, one number for each pair of id and SHA-256: a hash, of the pairs in ``moved`` another one."""
    if moved is None:
        return rows.withColumn("k", _hash(F.col("id"), F.col("sha")))
    known = moved.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "round")
    met = rows.join(known, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").drop("_id", "_sha")
    own = F.when(F.col("round").isNull(), _hash(F.col("id"), F.col("sha"))).otherwise(_hash(F.col("id"), F.col("sha"), F.col("round")))
    return met.withColumn("k", own).drop("round")


def _moved(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``id, sha, round`` of the pairs that need another hash for no two different ones to have one key; None without any, as a rule."""
    moved = None
    for number in range(1, KEY_ROUNDS + 1):
        keyed = _with_key(rows.select("id", "sha"), moved)
        several = scratch.save(keyed.groupBy("k").count().where("count > 1").select("k"), "several")
        if several.isEmpty():
            return moved
        pair = F.struct("id", "sha")
        clash = keyed.join(several, "k", "left_semi").groupBy("k").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).where("NOT low <=> high").select("k")
        clash = scratch.save(clash, "clash")
        if clash.isEmpty():
            return moved
        again = scratch.save(keyed.join(clash, "k", "left_semi").select("id", "sha").distinct().withColumn("round", F.lit(number)), "again")
        if moved is not None:
            new = again.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"))
            again = scratch.save(moved.join(new, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_anti").union(again), "moved")
        moved = again
    raise RuntimeError(f"keys still clash after {KEY_ROUNDS} hashes")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (start and stop of each).

    A byte is removed if a ``length``-byte string that also starts anywhere else, in any document, covers it. Defined cases:
    null and shorter texts lose nothing; rows that repeat are two places, so each loses all of its long strings; null
    ids are kept; an empty table gives an empty result; other columns are not read. ``length`` must exceed ``GRAM``.
    """
    rows, kept, _ = _found(docs, Scratch(docs.sparkSession, "suffix"), id_col, text_col, length)
    out = rows.join(kept, "k", "left")
    none = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans. A character of which a span has only a part stays whole."""
    for batch in slices(batches):
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
            parts, at = [], 0
            for span in spans or ():
                a, b = span["start"], span["stop"]
                while a < len(text) and text[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(text) and text[b] & 0xC0 == 0x80:
                    b -= 1
                if a < b:
                    parts.append(text[at:a])
                    at = b
            out.append(None if text is None else b"".join(parts) + text[at:])
        yield batch.set_column(batch.schema.get_field_index("_text"), "_text", pa.array(out, pa.binary()))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with the same rows and columns, repeated passages cut out of the text.

    What ``repeated_passages`` finds goes, but for parts of characters at the edges, so that texts stay UTF-8. Null texts stay null.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    _, kept, moved = _found(docs, scratch, id_col, text_col, length)
    spans = kept.select(F.col("k").alias("_k"), F.col("spans").alias("_spans"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit(""))
    read = docs.toDF(*names).withColumn("id", F.col(names[docs.columns.index(id_col)])).withColumn("sha", F.sha2(text, 256))
    keyed = _with_key(read, moved).withColumnRenamed("k", "_k").join(spans, "_k", "left")
    hit = keyed.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), "_spans", F.col(names[docs.columns.index(text_col)]).cast("binary").alias("_text"))
    out = hit.mapInArrow(_cut, hit.schema).withColumn(text_col, F.col("_text").cast("string"))
    return out.select(docs.columns)


def _found(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Written tables: ``id, k, sha, n`` of all rows, by ``k`` the removed spans of those that lose any, and what ``_with_key`` needs for the keys."""
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.sha2(text, 256)
    read = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), sha.alias("sha"), F.octet_length(text).cast("long").alias("n"))
    rows = scratch.save(read.select("id", "sha", "n"), "rows")
    moved = _moved(rows, scratch)
    rows, read = scratch.save(_with_key(rows, moved), "keyed"), _with_key(read, moved)
    copies = scratch.save(rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("n") >= length, F.col("n"))), F.lit(0))).first()
    buckets, groups = max(LEAST, size // _rate(length) // BUCKET), max(LEAST, count // GROUP)
    once = read.where(F.col("n") >= length).select("k", "text", F.lit(1).cast("long").alias("c"))
    if not copies.isEmpty():
        once = once.groupBy("k").agg(F.first("text").alias("text"), F.sum("c").alias("c"))

    anchors = once.mapInArrow(_to_buckets(_anchor_rows(length), 1, buckets, groups, lone=True), PACKS)
    lone = anchors.groupBy("part").applyInArrow(_chosen(4, 1, groups, lone=True), PACKS)
    lone = scratch.save(_documents(lone, ["at"]), "lone")
    alive = once.join(lone, "k", "left").select("k", "text", "entries")
    alive = scratch.save(alive.mapInArrow(_alive_runs(length), "k long, text binary, low array<bigint>, high array<bigint>"), "alive")
    scratch.drop(lone)

    named = scratch.save(alive.mapInArrow(_name_rows(length), "k long, s long, names array<bigint>, needs array<int>").withColumn("id", F.xxhash64("names", "needs")), "named")
    strings = scratch.save(named.groupBy("id", "names", "needs").agg(F.count(F.lit(1)).alias("copies")), "strings")
    shared = shared_names(strings, scratch)
    # equal strings share everything with each other
    all_of = F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda j: F.struct(j.cast("long").alias("j"), F.lit(FAR).cast("long").alias("shared")))
    own = scratch.save(strings.join(shared, "id", "left").select("id", F.when(F.col("copies") > 1, all_of).otherwise(F.col("shared")).alias("shared")), "own")
    per_doc = named.select("k", "s", "id").join(own, "id").groupBy("k").agg(F.collect_list(F.struct("s", "shared")).alias("known"))
    per_doc = scratch.save(per_doc, "known")
    known = alive.join(per_doc, "k", "left").join(copies, "k", "left").select("k", "text", "low", "high", "known", F.coalesce("copies", F.lit(1)).alias("copies"))
    cells = scratch.save(known.mapInArrow(_to_buckets(_cell_rows(length), 3, buckets, groups), PACKS), "cells")
    scratch.only(*(t for t in (rows, moved, copies, alive, cells) if t is not None))

    judged = scratch.save(cells.where("NOT sure").groupBy("part").applyInArrow(_cell_kinds(groups), CELLS), "kinds")
    # any one cell stands for its kind, and the written table fixes which
    kinds = judged.where("part IS NULL").select("inner", "n", "k", "lo", "hi")
    open_ = kinds.groupBy("inner").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1 AND inner <> 0").select("inner")
    tried = kinds.join(scratch.save(open_, "open"), "inner", "left_semi").unionByName(kinds.where("inner = 0"))
    tried = scratch.save(tried.groupBy("k").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("cells"), F.sum(F.col("hi") - F.col("lo") + 1).alias("m")), "tried")
    buckets = max(LEAST, tried.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] // BUCKET)
    windows = alive.select("k", "text").join(tried.select("k", "cells"), "k").mapInArrow(_to_buckets(_window_rows(length), 1, buckets, groups), PACKS)
    # rolling hashes choose, digests decide
    chosen = scratch.save(_documents(_judged(scratch.save(windows, "windows"), 1, ["at", "n", "lo"], groups), ["at", "n", "lo"]), "chosen")
    digested = alive.select("k", "text").join(chosen, "k").mapInArrow(_to_buckets(_digest_rows(length), 2, buckets, groups), PACKS)
    digested = scratch.save(digested, "digested")
    repeated = _judged(digested, 2, ["lo", "hi"], groups)
    whole = judged.where("part IS NOT NULL").select("part", "sure", "body").unionByName(cells.where("sure"))
    runs = scratch.save(_documents(repeated.unionByName(whole), ["lo", "hi"]), "runs")
    scratch.only(*(t for t in (rows, moved, alive, runs) if t is not None))
    kept = alive.select("k", "text").join(runs, "k").mapInArrow(_kept(length), "k long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>")
    kept = scratch.save(kept, "kept")
    scratch.only(*(t for t in (rows, kept, moved) if t is not None))
    return rows, kept, moved
