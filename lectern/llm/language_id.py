"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product of its letters' vectors, each permuted by its
place; a text is the bundle (sum) of its n-grams' vectors. A language's prototype is the bundle of its training texts, and
a text takes the language of the nearest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held, slices

DIM = 512
GRAM = 3
UNKNOWN = "und"
#: How sharply the score prefers the nearest prototype.
SHARPNESS = 24.0
KEPT_GRAMS = 32_768
#: A text of at least LEAST_GRAMS n-grams resembles no language if its best cosine is at most LEAST_SIGMAS standard deviations of what
#: unrelated vectors have (one over the square root of the dimension).
LEAST_GRAMS, LEAST_SIGMAS = 100, 2.25
#: More different labels than there are languages: then they aren't languages.
MOST_LANGS = 8_192


class Encoder:
    """Bundles texts; vectors of at most ``KEPT_GRAMS`` n-grams are kept, others are bound anew."""

    def __init__(self, dim: int = DIM, seed: int = 7):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dim), dtype=np.int8)
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            rng = np.random.default_rng((self.seed, code))
            self.letters[code] = (rng.integers(0, 2, self.dim) * 2 - 1).astype(np.float32)
        return self.letters[code]

    def bound(self, gram: int) -> np.ndarray:
        """The n-gram's vector: its letters' vectors, permuted by place and multiplied."""
        out = np.ones(self.dim, dtype=np.float32)
        for place in range(GRAM):
            out *= np.roll(self.letter((gram >> (21 * place)) & 0x1FFFFF), place)
        return out

    def grams(self, text: str) -> np.ndarray:
        """Codes of all letter n-grams; runs of other characters count as one space, at both ends as well."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        is_letter = self.alpha[codes]
        if not is_letter.any():
            return codes[:0]
        codes = np.concatenate([[0], np.where(is_letter, codes, 0), [0]])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        out = codes[: len(codes) - GRAM + 1].copy()
        for place in range(1, GRAM):
            out |= codes[place : len(codes) - GRAM + 1 + place] << (21 * place)
        return out

    def bundle(self, grams: np.ndarray) -> np.ndarray | None:
        """The bundle of a text's n-grams, their counts damped by the square root; None without any."""
        if not len(grams):
            return None
        distinct, counts = np.unique(grams, return_counts=True)
        known, extra = [], None
        weights = np.sqrt(counts).astype(np.float32)
        for at, gram in enumerate(distinct.tolist()):
            row = self.rows.get(gram)
            if row is None and len(self.rows) < KEPT_GRAMS:
                row = self.rows[gram] = len(self.rows)
                if row == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[row] = self.bound(gram)
            elif row is None:
                extra = (0 if extra is None else extra) + weights[at] * self.bound(gram)
                weights[at], row = 0, 0
            known.append(row)
        out = weights @ self.vectors[known].astype(np.float32)
        return out if extra is None else out + extra


def _encoder(dim: int, seed: int) -> Encoder:
    return held(("grams", dim, seed), lambda: Encoder(dim, seed))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 3000,
    dim: int = DIM, seed: int = 7,
) -> dict[str, np.ndarray]:
    """Prototypes, by language, from about ``sample_per_lang`` rows of each language.

    The rows are chosen by a hash of their id and text, evenly over the table, so rows that repeat an id or have none are chosen like others.
    Rows without a language are not used. Over MOST_LANGS different labels are an error: a prototype of each goes to the driver.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = rows.where("lang IS NOT NULL")
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"{lang_col} has over {MOST_LANGS} different labels")
    if not sizes:
        return {}
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_per_lang / r["count"])) for r in sizes], "lang string, share double")
    lot = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(F.broadcast(shares), "lang").where(lot < F.col("share")).select("text", "lang")  # a row for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        coder = _encoder(dim, seed)
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (v := coder.bundle(coder.grams(text or ""))) is not None and (norm := np.linalg.norm(v)):
                    sums[lang] = sums.get(lang, 0) + (v / norm).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v)], ["lang", "dim", "value"])

    parts = chosen.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    whole = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", F.transform("v", lambda x: x["value"]).alias("v"))
    out = {r.lang: np.array(r.v) for r in whole.collect()}  # a row of dim numbers for each language
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(out.items())}


def predict(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, seed: int = 7
) -> DataFrame:
    """id, ``lang_pred``, ``score`` (0 to 1), ``cosine`` for each row; ``und`` and 0 for texts that are null or have no letter.

    Defined cases: equal cosines go to the first language by name; without prototypes all rows are ``und``; rows that
    repeat are judged singly; null ids are kept; other columns are not read.
    """
    judge = _judge(prototypes, dim, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [judge(t)[:3] for t in batch.column(1).to_pylist()]
            arrays = [pa.array(x, t) for x, t in zip(zip(*made) if made else ([], [], []), (pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "lang_pred", "score", "cosine"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = read.mapInArrow(run, f"id {kind}, lang_pred string, score double, cosine double")
    return out.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language; a null language is filled in.

    Rejected are texts that are null or have no letter, and texts of LEAST_GRAMS letter n-grams or more that resemble no known
    language: their best cosine is hardly above chance. Shorter texts can't be told from chance so surely, and stay. Without
    prototypes nothing is known and no row stays; rows that repeat are judged alike.
    """
    judge = _judge(prototypes, dim, seed)
    least = LEAST_SIGMAS / dim**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [judge(t) for t in batch.column(text_col).to_pylist()]
            known = [lang != UNKNOWN and (cosine > least or n < LEAST_GRAMS) for lang, _, cosine, n in made]
            at = batch.schema.get_field_index(lang_col)
            if at >= 0 and pa.types.is_string(batch.schema.field(at).type):
                langs = [x if x is not None else lang for x, (lang, _, _, _) in zip(batch.column(at).to_pylist(), made)]
                batch = batch.set_column(at, lang_col, pa.array(langs, batch.schema.field(at).type))
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _judge(prototypes: dict[str, np.ndarray], dim: int, seed: int) -> Callable[[str | None], tuple[str, float, float, int]]:
    """A function from a text to language, score, cosine and number of n-grams."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dim)
    # what all languages share says nothing about which it is
    shared = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dim)
    centred = matrix - shared
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def judge(text: str | None) -> tuple[str, float, float, int]:
        coder = _encoder(dim, seed)
        grams = coder.grams(text or "")
        bundle = coder.bundle(grams) if names else None
        norm = np.linalg.norm(bundle) if bundle is not None else 0
        if not norm:
            return UNKNOWN, 0.0, 0.0, len(grams)
        unit = bundle / norm
        away = unit - shared * (shared @ unit) / max(shared @ shared, 1e-12)
        cos = centred @ (away / max(np.linalg.norm(away), 1e-12))
        best = int(np.argmax(cos))
        return names[best], float(1 / np.exp(SHARPNESS * (cos - cos[best])).sum()), float(cos[best]), len(grams)

    return judge
