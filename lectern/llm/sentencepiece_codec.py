"""SentencePiece encoding and decoding with seeded merge-dropout.

A text is cut where no piece of the model can reach across: before every run of spaces, and, if the vocabulary allows, before
a full stop or comma after a letter and around line ends. In each part, candidate merges wait in an agenda by score; one that comes up
is skipped if a keyed hash of seed, document, place in the text and piece says so. The hash makes a segmentation repeatable
anywhere, and another seed, document or place gives another one. All of them decode to the same text.

Parts of one length go through their agendas side by side: a column of candidates for each part, of which every step takes the
best, draws, and merges or skips. Nothing is kept from one part to the next, so each occurrence of a word draws anew.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, held, slices

SPACE = "▁"
AT_SPACES = re.compile(" *[^ ]+| +")
AT_MARKS = re.compile(r"\n| *[^ \n]*?[A-Za-zÀ-ɏ](?=[.,])| *[^ \n]+| +")
#: A piece that AT_MARKS would cut.
CROSSES = re.compile(r"[A-Za-zÀ-ɏ][.,]|.\n|\n.", re.S)
#: Before a run of spaces: every part ends there.
RUN = re.compile("(?<=[^ ]) ")
#: Characters that are coded together, and those of a long text that are cut at a time.
BLOCK = 1 << 17

_ODD, _MULTIPLIER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACES = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(number: int, place: int) -> int:
    return number * 0x9E3779B97F4A7C15 + place * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF


def _part_keys(key: int, n: int, first: int = 0) -> np.ndarray:
    """A key for each of the ``n`` parts of a text from part ``first`` on."""
    keys = np.arange(first + 1, first + n + 1, dtype=np.uint64) * _ODD + np.uint64(key)
    keys = (keys ^ (keys >> np.uint64(33))) * _MULTIPLIER
    return keys ^ (keys >> np.uint64(29))


class Merges:
    """Which two symbols merge: rank and number of the piece that they make. A table in which a pair has one of two places.

    A symbol is the number of a piece, or ``size`` and the code of a character that is no piece.
    """

    NONE = 1 << 30
    PAD = (1 << 21) - 1

    def __init__(self, pieces: dict[str, int], ranks: dict[str, float], size: int):
        order = {r: n for n, r in enumerate(sorted(set(ranks.values())))}
        symbol = {**{c: size + ord(c) for p in pieces for c in p}, **pieces}
        pairs = {}
        for piece, number in pieces.items():
            for i in range(1, len(piece)):
                if piece[:i] in symbol and piece[i:] in symbol:
                    pairs[symbol[piece[:i]] << 21 | symbol[piece[i:]]] = (order[ranks[piece]], number)
        self.shift = np.uint64(64 - max(4, (3 * len(pairs)).bit_length()))
        places = [x.tolist() for x in self._places(np.array(list(pairs), dtype=np.uint64))]
        where = dict(zip(pairs, zip(*places)))
        table: dict[int, int] = {}
        for pair, (at, _) in where.items():
            for _ in range(500):
                pair, table[at] = table.get(at), pair
                if pair is None:
                    break
                at = sum(where[pair]) - at  # whoever stood there goes to its other place
            else:
                raise RuntimeError("no table of merges found")
        size = 1 << int(np.uint64(64) - self.shift)
        self.pairs, self.rank, self.piece = np.full(size, 2**63, np.uint64), np.full(size, self.NONE, np.int32), np.zeros(size, np.int32)
        for at, pair in table.items():
            self.pairs[at], (self.rank[at], self.piece[at]) = pair, pairs[pair]
        self.rank[self.rank < self.NONE] <<= 6

    def _places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = (pairs * _ODD) >> self.shift
        return first.astype(np.int64), ((pairs ^ (pairs >> np.uint64(17))) * _MULTIPLIER >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank, shifted by six bits, and the piece of each pair; the rank NONE and any piece for pairs that don't merge."""
        pairs = left.astype(np.uint64) << np.uint64(21) | right.astype(np.uint64)
        first, second = self._places(pairs)
        at = np.where(self.pairs[first] == pairs, first, second)
        return np.where(self.pairs[at] == pairs, self.rank[at], self.NONE), self.piece[at]


class Codec:
    """Encodes and decodes with one model."""

    LONGEST = 48
    LISTED = 24
    NONE = float("inf")

    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ranks: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.output: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.output.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.output.append(b"")
            else:
                self.ids[piece], self.ranks[piece] = i, -model.get_score(i)
                self.output.append(piece.replace(SPACE, " ").encode())
        self.cut = AT_SPACES if any(map(CROSSES.search, self.ids)) else AT_MARKS
        self.limit = int(dropout * 2**32)
        self.seed = seed
        self.merges = Merges(self.ids, self.ranks, self.size)
        self.symbols = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.symbols[ord(" ")] = self.symbols[ord(SPACE)]

    def key(self, document: int) -> int:
        return xxhash.xxh64_intdigest(struct.pack("<qq", self.seed, document))

    def _skipped(self, number: int, place: int, key: int) -> bool:
        """Whether the candidate for piece ``number`` at ``place`` is skipped: a keyed hash is below the limit."""
        mixed = key ^ _mixed(number, place)
        return ((mixed ^ (mixed >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32 < self.limit

    def segment(self, part: str, key: int, base: int = 0) -> list[str]:
        """The pieces of one part: the best candidate of the agenda first, equal ones from the left, skipped ones never again.

        The agenda is a list for parts of ordinary length and a heap for longer ones. ``base`` is the part's first place.
        """
        return self._listed(list(part), key, base) if len(part) <= self.LISTED else self._heaped(list(part), key, base)

    def _listed(self, symbols: list[str], key: int, base: int = 0) -> list[str]:
        get, limit, none = self.ranks.get, self.limit, self.NONE
        agenda = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        places = list(range(len(symbols)))
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            if limit and self._skipped(self.ids[symbols[i] + symbols[i + 1]], base + places[i], key):
                agenda[i] = none
                continue
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], places[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _heaped(self, symbols: list[str], key: int, base: int = 0) -> list[str]:
        """Symbols are a linked list; an agenda entry is stale if a side has changed since."""
        get, limit, n = self.ranks.get, self.limit, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str]] = []

        def propose(i: int, piece: str) -> None:
            if (rank := get(piece)) is not None:
                heapq.heappush(agenda, (rank, i, piece))

        for i in range(n - 1):
            propose(i, symbols[i] + symbols[i + 1])
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue
            if limit and self._skipped(self.ids[piece], base + i, key):
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                propose(i, piece + symbols[k])
            if before[i] >= 0:
                propose(before[i], symbols[before[i]] + piece)
        return [s for s in symbols if s]

    def _part_ids(self, part: str, key: int) -> bytes:
        """The ids of one part, by itself."""
        out: list[int] = []
        base = 0
        for section in re.split(f"({SPACE})", part) if SPACE in part else (part,):
            if section == SPACE:  # the character itself, not a space: by its bytes
                out += [self.byte_ids[b] for b in SPACE.encode()]
                base += 1
                continue
            for piece in self.segment(section.replace(" ", SPACE), key, base) if section else ():
                if piece in self.ids:
                    out.append(self.ids[piece])
                else:
                    out += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            base += len(section)
        return struct.pack(f"<{len(out)}I", *out)

    def _agendas(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The symbols of parts, one in each column, after all merges: a merged one stands where it begins, -1 where it goes on."""
        width, n = symbols.shape
        done, columns = symbols, np.arange(n)
        agenda, piece = self.merges.find(symbols[:-1], symbols[1:])
        agenda |= np.arange(width - 1, dtype=agenda.dtype)[:, None]
        after = np.repeat(np.arange(1, width + 1)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, width - 1)[:, None], n, axis=1)
        none, limit = Merges.NONE, np.uint64(self.limit)
        symbols = symbols.copy()
        while True:
            best = agenda.min(axis=0)
            at = np.flatnonzero(best < none)
            if 2 * len(at) < len(columns):  # parts without a candidate leave
                done[:, columns] = symbols
                if not len(at):
                    return done
                columns, keys, best = columns[at], keys[at], best[at]
                symbols, agenda, piece, after, before = (x[:, at] for x in (symbols, agenda, piece, after, before))
                at = np.arange(len(at))
            i = best[at] & 63
            number = piece[i, at]
            if limit:
                mixed = keys[at] ^ (number.astype(np.uint64) * _ODD + i.astype(np.uint64) * _PLACES)
                skipped = ((mixed ^ (mixed >> np.uint64(31))) * _MULTIPLIER) >> np.uint64(32) < limit
                agenda[i[skipped], at[skipped]] = none
                i, at, number = i[~skipped], at[~skipped], number[~skipped]
            j = after[i, at]
            k = after[j, at]
            symbols[i, at], symbols[j, at] = number, -1
            after[i, at] = k
            inside = j < width - 1
            agenda[j[inside], at[inside]] = none
            more = k < width
            agenda[i[~more], at[~more]] = none
            left, right, column = i[more], k[more], at[more]
            before[right, column] = left
            rank, made = self.merges.find(number[more], symbols[right, column])
            agenda[left, column], piece[left, column] = rank | left, made
            left = before[i, at]
            more = left >= 0
            left, column = left[more], at[more]
            rank, made = self.merges.find(symbols[left, column], number[more])
            agenda[left, column], piece[left, column] = rank | left, made

    def _block(self, texts: list[str], keys: list[int], firsts: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The ids of all texts in a row, where each text's end, and how many parts each had; ``firsts``: the number of its first part."""
        parts = [self.cut.findall(t) for t in texts]
        counts = [len(p) for p in parts]
        sizes = np.fromiter((len(p) for own in parts for p in own), dtype=np.int64, count=sum(counts))
        starts = np.cumsum(sizes) - sizes
        drawn = np.concatenate([_part_keys(*x) for x in zip(keys, counts, firsts)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.symbols[codes]
        alone = sizes > self.LONGEST
        if SPACE in self.ids and len(odd := np.flatnonzero(codes == ord(SPACE))):
            alone[np.searchsorted(starts, odd, "right") - 1] = True
        classes = np.where(alone | (sizes < 2), 0, np.where(sizes > 12, (sizes + 7) // 8 * 8, sizes))
        order = np.argsort(classes, kind="stable")
        edges = np.flatnonzero(np.diff(classes[order], prepend=-1))
        for rows in np.split(order, edges[1:]):
            if width := int(classes[rows[0]]):
                place = np.arange(width)[:, None]
                inside = place < sizes[rows]
                at = np.where(inside, starts[rows] + place, 0)
                made = self._agendas(np.where(inside, symbols[at], Merges.PAD), drawn[rows])
                symbols[at[inside]] = made[inside]
        widths = (symbols >= 0).astype(np.int64)
        strange = np.flatnonzero(symbols >= self.size)
        widths[strange] = 1 + (codes[strange] > 0x7F) + (codes[strange] > 0x7FF) + (codes[strange] > 0xFFFF)
        single = {}
        for n in np.flatnonzero(alone).tolist():
            text = np.ascontiguousarray(codes[starts[n] : starts[n] + sizes[n]]).tobytes().decode("utf-32-le", "surrogatepass")
            single[int(starts[n])] = ids = np.frombuffer(self._part_ids(text, int(drawn[n])), "<u4")
            widths[starts[n] : starts[n] + sizes[n]] = 0
            widths[starts[n]] = len(ids)
        ends = np.cumsum(widths)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        plain = np.flatnonzero(widths == 1)
        out[ends[plain] - 1] = symbols[plain]
        for at in strange.tolist():
            if widths[at] and at not in single:
                data = chr(codes[at]).encode("utf-8", "surrogatepass")
                out[ends[at] - len(data) : ends[at]] = [self.byte_ids[b] for b in data]
        for at, ids in single.items():
            out[ends[at] - len(ids) : ends[at]] = ids
        last = np.cumsum([len(t) for t in texts]) - 1
        return out, ends[last], counts

    def encode_all(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """The ids of each text. Its n-th part draws by a hash of seed, document and n.

        Texts are coded together up to about BLOCK characters; a longer one is cut before runs of spaces.
        """
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []

        def code() -> None:
            if waiting:
                ids, ends, _ = self._block([t for _, t in waiting], [self.key(documents[n]) for n, _ in waiting], [0] * len(waiting))
                for (n, _), own in zip(waiting, np.split(ids, ends[:-1])):
                    out[n].append(own)
                waiting.clear()

        total = 0
        for n, text in enumerate(texts):
            if not text:
                continue
            text = " " + text
            if total + len(text) > BLOCK:
                code()
                total = 0
            if len(text) <= BLOCK:
                waiting.append((n, text))
                total += len(text)
                continue
            at = first = 0
            while at < len(text):
                stop = RUN.search(text, at + BLOCK)
                end = stop.start() if stop else len(text)
                ids, _, counts = self._block([text[at:end]], [self.key(documents[n])], [first])
                out[n].append(ids)
                at, first = end, first + counts[0]
        code()
        none = np.zeros(0, np.uint32)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else none for x in out]

    def encode(self, text: str, document: int = 0) -> bytes:
        """The ids of ``text`` as little-endian 32-bit bytes."""
        return self.encode_all([text], [document])[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding puts first goes."""
        output = self.output
        data = b"".join([output[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return data.removeprefix(b" ").decode("utf-8", "replace")


def codec(path: str, dropout: float = 0.1, seed: int = 0) -> Codec:
    key = (path, dropout, seed)
    return held(("pieces", *key), lambda: Codec(*key))


def encode(
    docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """id, ``n_tokens``, ``n_bytes``, ``ids_crc32``, ``lossless`` and (unless ``with_ids`` is off) ``ids`` for each row.

    ``model`` is the path of a merge-type (BPE) model with byte fallback that every executor can read. ``dropout`` is the
    share of candidate merges that are skipped; 0 gives the model's own segmentation. Each merge of each word draws by seed, id
    and place in the text. ``lossless`` says that the ids decode to the text. Defined cases: null and empty texts have no token; rows that repeat are
    encoded alike; null ids count as one id; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, dropout, seed)
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            coded = own.encode_all(texts, batch.column(2).to_pylist())
            sums, same = [], []
            for text, ids in zip(texts, coded):
                data = ids.astype("<u4").tobytes()
                sums.append(crc32(data)), same.append(own.decode(data) == text)
            sizes = [len(x) for x in coded]
            lengths = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, lengths, sums)), pa.array(same, pa.bool_())]
            names = ["id", "n_tokens", "n_bytes", "ids_crc32", "lossless"]
            if with_ids:
                ends = np.cumsum([0, *sizes]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *coded]).astype(np.int32)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    document = F.xxhash64(F.col(id_col), F.lit(seed))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), document.alias("document"))
    schema = f"id {kind}, n_tokens long, n_bytes long, ids_crc32 long, lossless boolean" + (", ids array<int>" if with_ids else "")
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` from rows of token ids; null ids give null, ids out of the model's range an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, 256):
            texts = [None if ids is None else own.decode(np.array(ids, dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = rows.select(id_col).schema[0].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
