"""Best-fit packing by hierarchical residual packing.

Documents become token ids, and only longer ones are cut into full pieces. Every partition packs its pieces best-fit
decreasing and emits the bins that are nearly full. Underfull bins are items again: they go, whole, to fewer
partitions, round by round, until one partition is left or a round saves nothing.
No task ever holds more than ``task_items`` items on average.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc32, held, portions, slices, utf8

FAN_IN = 8


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, by way of the ids of their space-separated words.

    The tokenizer lower-cases and never joins text across a space or a line end, so a text's ids are its lower-cased words'
    ids in order. Unknown words of letters, with or without a mark after them, are encoded as one text and told apart by the
    ids that end a word. Two generations of at most ``most`` words bound the memory; frequent words stay.
    """

    LONGEST = 48
    #: UTF-8 letters that the tokenizer only lower-cases, A-Z done, and a mark that may follow.
    PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]?)")

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.young, self.old = most, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._bytes(self._encode([m.decode()])[0]) for m in (b".", b",")}
        self.quick = self._by_rank(json.loads(self.tokenizer.to_str())["model"])

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _by_rank(model: dict) -> object | None:
        """The same merges for a coder that is quicker on words: tokens as bytes, a space for the word's end, rank for id.

        That is the same coding if the ids of merged tokens rise in the order of the merges; else None.
        """
        vocabulary = model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocabulary[t] for t in merged]
        single = [i for t, i in vocabulary.items() if len(t.removesuffix("</w>")) == 1]
        if model.get("end_of_word_suffix") != "</w>" or ids != sorted(ids) or max(single) > min(ids):
            return None
        import tiktoken

        # byte-level characters: printable bytes stand for themselves, the others for 256 and on, in order
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        octet = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
        ranks = {}
        for token, i in vocabulary.items():
            body = token.removesuffix("</w>")
            if all(c in octet for c in body):
                ranks.setdefault(bytes(octet[c] for c in body) + b" " * token.endswith("</w>"), i)
        if not all(bytes([b]) in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words, lower-cased, by one call of a coder."""
        text = b" ".join(words).decode()
        if self.quick:
            ids = np.array(self.quick.encode_ordinary(text.lower() + " "), dtype="<u4")
        else:
            ids = np.array(self._encode([text])[0], dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words):
            return [self._bytes(i) for i in self._encode([w.decode() for w in words])]
        data, stops = ids.tobytes(), stops.tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The ids of the words in ``new``; the longest are returned and not kept."""
        young, old, marks, fits = self.young, self.old, self.marks, self.PLAIN.fullmatch
        whole: list[bytes] = []
        bases: set[bytes] = set()
        marked: list[tuple[bytes, bytes, bytes]] = []
        for word in new:
            found = fits(word)
            if not found:
                whole.append(word)
                continue
            base, mark = found.groups()
            if mark:
                marked.append((word, base, mark))
                if base in young:
                    continue
                if base in old:
                    young[base] = old[base]
                    continue
            bases.add(base)
        plain = list(bases)
        for start in range(0, len(plain), 4096):
            part = plain[start : start + 4096]
            young.update(zip(part, self._plain(part)))
        for word, base, mark in marked:
            young[word] = young[base] + marks[mark]
        once: dict[bytes, bytes] = {}
        for word, ids in zip(whole, self._encode([w.decode("utf-8", "surrogatepass") for w in whole])):
            (young if len(word) <= self.LONGEST else once)[word] = self._bytes(ids)
        return once

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts."""
        split = [t.lower().replace(b"\n", b" ").split(b" ") for t in texts]
        young, old = self.young, self.old
        get = young.get
        found = [list(map(get, words)) for words in split]
        holes = [[i for i, ids in enumerate(row) if ids is None] if None in row else () for row in found]
        missing = {words[i] for words, at in zip(split, holes) for i in at}
        known = {word for word in missing if word in old}
        young.update((word, old[word]) for word in known)
        once = self._learn(missing - known)
        for words, row, at in zip(split, found, holes):
            for i in at:
                row[i] = young[words[i]] if words[i] in young else once[words[i]]
        if len(young) > self.most:
            self.young, self.old = {}, young
        return [b"".join(row) for row in found]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """``id, piece, start, length, crc``: the pieces of each document's ids, its end id included. Null text is empty."""
    end, step = struct.pack("<I", end_id), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(("words", tokenizer), lambda: WordIds(tokenizer))
        for batch in slices(batches):
            texts = utf8(batch.column(1))
            for low, high in portions(texts):
                rows, cols = [], ([], [], [], [])
                for row, ids in enumerate(coder.encode([t or b"" for t in texts[low:high]]), low):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append(row)
                        for col, x in zip(cols, (n, at // 4, len(part) // 4, crc32(part))):
                            col.append(x)
                arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "crc"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers. Items are taken in the given order, each into the fullest bin that has room.

    Open bins stand in lists by room left; one big integer has a bit for each list that isn't empty.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for item, need in enumerate(sizes.tolist()):
        fits = there >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                there ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if left := room - need:
            by_room[left].append(at)
            there |= 1 << left
    return bins


def _packed(kind: str, capacity: int, emit_at: int, round_no: int) -> tuple[object, str]:
    """The partition function of a round and its schema."""
    member = f"struct<id:{kind},piece:int,start:bigint,length:bigint,crc:bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        items = pa.Table.from_batches(got) if got else None
        if not items or not items.num_rows:
            return
        # the order in which shuffled rows arrive must not matter: a task that runs again packs alike
        sizes, ties = items["size"].to_numpy(), items["tie"].to_numpy()
        order = np.lexsort((ties, -sizes))
        sizes, members = sizes[order], items["members"].combine_chunks().take(pa.array(order))
        bins = best_fit(sizes, capacity)
        fills = np.array([sum(sizes[b].tolist()) for b in bins], dtype=np.int64)
        taken = members.take(pa.array(np.concatenate([np.asarray(b) for b in bins])))
        counts = np.add.reduceat(taken.value_lengths().to_numpy(), np.cumsum([0] + [len(b) for b in bins[:-1]]))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(ends), taken.flatten())
        first = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        ids = pa.array(np.arange(len(bins), dtype=np.int64) + first)
        table = pa.table([pa.array(fills), ids, made, pa.array(fills >= emit_at)], names=["size", "tie", "members", "full"])
        yield from table.to_batches(max_chunksize=2048)

    return run, f"size long, tie long, members array<{member}>, full boolean"


def pack(items: DataFrame, scratch: Scratch, capacity: int = 2048, slack: int = 8, task_items: int = 16384, max_rounds: int = 12) -> DataFrame:
    """``id, piece, start, length, crc, sequence_id, offset`` for the rows of ``pieces``."""
    kind = items.schema["id"].dataType.simpleString()
    left = items.select(
        F.col("length").alias("size"),
        F.xxhash64("id", "piece").alias("tie"),
        F.array(F.struct("id", "piece", "start", "length", "crc")).alias("members"),
    )
    # what is full already can't be joined and says nothing about whether the rest still can
    whole = F.count(F.when(F.col("length") >= capacity - slack, 1)).alias("whole")
    count, whole = items.agg(F.count(F.lit(1)), whole).first()
    tasks, done, round_no = None, [], 0
    while count:
        most = -(-count // task_items)
        tasks = most if tasks is None else max(most, -(-tasks // FAN_IN))
        run, schema = _packed(kind, capacity, capacity - slack, round_no)
        dealt = left.repartition(tasks, F.xxhash64("tie", F.lit(round_no)))
        bins = scratch.save(dealt.mapInArrow(run, schema), "bins")
        made = bins.groupBy("full").count().collect()
        full, open_ = (sum(r["count"] for r in made if r["full"] is x) for x in (True, False))
        round_no += 1
        last = not open_ or tasks == 1 or round_no == max_rounds or (full + open_ - whole) > 0.995 * (count - whole)
        done.append(bins if last else bins.where("full"))
        if last:
            break
        left, count, whole = bins.where("NOT full").drop("full"), open_, 0
    rows = None
    for bins in done:
        rows = bins.select("tie", "members") if rows is None else rows.union(bins.select("tie", "members"))
    if rows is None:
        rows = left.select("tie", "members")
    return rows.select(F.col("tie").alias("sequence_id"), F.inline(_placed(F.col("members"))))


def _placed(members: Column) -> Column:
    """The members with their gapless offsets."""
    zero = F.lit(0).cast("long")
    offsets = F.transform(members, lambda _, i: F.aggregate(F.slice(members, 1, i), zero, lambda a, x: a + x["length"]))
    return F.zip_with(
        members, offsets,
        lambda m, o: F.struct(m["id"].alias("id"), m["piece"].alias("piece"), m["start"].alias("start"), m["length"].alias("length"), m["crc"].alias("crc"), o.alias("offset")),
    )


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. Defined cases: null and empty texts are
    the end id alone; longer documents than ``size`` are cut into full pieces and a last shorter one; rows that repeat are
    packed singly; null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    items = scratch.save(pieces(docs, tokenizer, id_col, text_col, size), "pieces")
    out = pack(items, scratch, size)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
