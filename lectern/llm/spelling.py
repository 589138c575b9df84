"""Spelling variants: words one edit apart, grouped under their frequent forms by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Words one insertion, deletion or replacement apart share one of
these keys, so an equi-join finds all of them; survivors are verified as exactly one edit apart. Keys are 64-bit hashes, made for a whole word from
sums over its beginning and end: in linear time, and a very long word is not copied once for each of its letters. As pairs are verified
on the words, colliding keys only cost a comparison. A key is shared by words of one or two lengths that differ
in one letter, so the number of words at a key is bounded by the alphabet and the length, however large the corpus.

A word's form is its most frequent neighbour, if that is frequent enough; forms are more frequent than their words, so following
them ends, and pointer doubling finds all roots in rounds logarithmic in the longest chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, crc32, slices, utf8

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task counts before it passes the counts on.
_HELD = 1 << 18
#: Keys of an Arrow batch.
_KEYS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def damaged(run: str, doc_id: str, one_in: int) -> str:
    """``run``, or what is left of it without one letter, for one in so many pairs of document and run."""
    h = crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_letters: int, damage: int | None) -> DataFrame:
    """``word, n`` with partial counts: a word is in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                # bytes.lower() changes A-Z only
                for word, n in Counter(_RUN.findall((text or b"").lower().decode())).items():
                    if damage:
                        word = damaged(word, doc_id, damage)
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) >= _HELD:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    read = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    return read.mapInArrow(run, "word string, n long")


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def deletion_keys(word: str) -> np.ndarray:
    """Keys of ``word`` and its distinct single deletions."""
    letters = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) * _MIX
    power = np.multiply.accumulate(np.full(len(letters) + 1, _BASE, dtype=np.uint64))
    start = np.concatenate([[np.uint64(0)], np.cumsum(letters * power[1:], dtype=np.uint64)])
    moved = letters * power[:-1]  # one place further to the left
    end = np.concatenate([np.cumsum(moved[::-1], dtype=np.uint64)[::-1], [np.uint64(0)]])
    return np.unique(np.concatenate([start[-1:], start[:-1] + end[1:]]))


def keys(words: DataFrame) -> DataFrame:
    """``key, id, letters`` for ``id, word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held: list[tuple[int, int, np.ndarray]] = []
            size = 0
            for id_, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((id_, len(word), deletion_keys(word)))
                size += len(held[-1][2])
                if size >= _KEYS:
                    yield _keyed(held)
                    held, size = [], 0
            if held:
                yield _keyed(held)

    return words.select("id", "word").mapInArrow(run, "key long, id long, letters int")


def _keyed(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(k) for _, _, k in held]
    ids, letters = np.repeat([i for i, _, _ in held], sizes), np.repeat(np.array([n for _, n, _ in held], dtype=np.int32), sizes)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for _, _, k in held]).view(np.int64)), pa.array(ids, pa.int64()), pa.array(letters)], ["key", "id", "letters"])


def neighbours(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: ids of the words of ``words`` (``id, word``) exactly one edit apart, each pair once."""
    found = scratch.save(keys(words), "keys")
    a, b = (found.select("key", F.col("id").alias(x), F.col("letters").alias(f"letters_{x}")) for x in "uv")
    shared = a.join(b, "key").where((F.col("u") < F.col("v")) & (F.abs(F.col("letters_u") - F.col("letters_v")) <= 1))
    pairs = scratch.save(shared.select("u", "v").distinct(), "pairs")
    left, right = (words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}")) for x in "uv")
    return verified(pairs.join(left, "u").join(right, "v").select("u", "v", "word_u", "word_v"))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``b`` of ``a``; linear in their letters."""
    same = len(commonprefix((a, b)))
    return a != b and (a[same + 1 :] == b[same + 1 :] or a[same + 1 :] == b[same:] or a[same:] == b[same + 1 :])


def verified(pairs: DataFrame) -> DataFrame:
    """``u, v`` of the rows of ``pairs`` (``u, v, word_u, word_v``) whose words are one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            near = [one_edit(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "u long, v long")


def roots(forms: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """``id, root``: where following ``forms`` (``id, form``; no cycles) from each of its ids ends."""
    at = forms.select("id", F.col("form").alias("root"))
    for _ in range(max_rounds):
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = scratch.save(at.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("id", "root")
        at = moved.select("id", "root")
    raise RuntimeError(f"forms lead on after {max_rounds} rounds")


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, ratio: int = 2, damage: int | None = None
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``least_letters`` letters and ``least_count`` occurrences or more.
    ``form`` is the most frequent word one edit apart (ties: the first in code-point order) if it has ``ratio`` times the
    occurrences at least, else null; ``root`` is where forms lead to. ``damage`` takes a letter out of one in so many runs per document, for tests.
    Defined cases: null and empty texts have no words; null ids count as empty text in ``damage``; rows that repeat count singly; an empty table
    gives an empty result; a word may be as long as its text, at a cost linear in its letters; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "spelling")
    counts = word_counts(docs, id_col, text_col, least_letters, damage).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    words = scratch.save(counts.withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = scratch.save(neighbours(words, scratch), "neighbours")
    both = pairs.union(pairs.select("v", "u")).toDF("id", "near")
    near = both.join(words.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word", "near")).alias("best")
    known = words.join(near.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best), "id", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    known = scratch.save(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("best")), "known")
    ends = roots(known.where("best IS NOT NULL").select("id", F.col("best.near").alias("form")), scratch)
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = known.join(named, "id", "left")
    return out.select("word", F.col("best.near_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))
