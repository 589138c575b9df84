"""Toxicity scores by votes of the nearest labelled examples.

Texts are TF-IDF vectors over label-informative features (words and word beginnings). Neighbours are exact by cosine: the
examples lie in blocks, the inverted index knows each feature's largest weight in every block, and blocks are visited by
falling upper bound until no block can hold a better one. Distance-weighted votes of the neighbours are calibrated on
the examples themselves, each without its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)
BLOCK = 128
BINS = 50
#: The one feature that stands for all words without a telling feature: it keeps how dense the telling ones are.
OTHER = "*"


def features(text: str) -> Counter[str]:
    """Counts of the lower-cased words and of the beginnings of longer words (marked ``*``)."""
    out: Counter[str] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        out[word] += n
        for size in BEGINNINGS:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


class Vocabulary:
    """Numbers of the telling features, words and beginnings apart, so that texts are read without making features."""

    def __init__(self, terms: list[tuple[str, float]]):
        self.words = {t: i for i, (t, _) in enumerate(terms) if t[-1] != "*"}
        self.begin = {size: {t[:-1]: i for i, (t, _) in enumerate(terms) if t[-1] == "*" and len(t) == size + 1} for size in BEGINNINGS}
        self.other = len(terms) - 1

    def sparse(self, text: str) -> tuple[list[int], list[float]]:
        """The numbers and counts of the text's telling features, and of ``OTHER`` for its other words; empty without any."""
        words, begin = self.words, self.begin
        least = begin[BEGINNINGS[0]]
        found: Counter[int] = Counter()
        counts = Counter(WORD.findall(text.lower()))
        other = 0
        for word, n in counts.items():
            if word in words:
                found[words[word]] += n
            else:
                other += n
            if word[: BEGINNINGS[0]] in least or len(word) > BEGINNINGS[0] and any(word[:size] in begin[size] for size in BEGINNINGS[1:]):
                for size in BEGINNINGS:
                    if len(word) > size and word[:size] in begin[size]:
                        found[begin[size][word[:size]]] += n
        if not found:
            return [], []
        if other:
            found[self.other] = other
        pairs = sorted(found.items())
        return [t for t, _ in pairs], [float(n) for _, n in pairs]


class Index:
    """Block-max inverted index over unit TF-IDF vectors of labelled examples."""

    def __init__(self, terms: list[tuple[str, float]], examples: list[tuple[int, int, list[int], list[float]]], k: int):
        """terms: feature and idf, ``OTHER`` last; examples: id, label, feature numbers, term frequencies."""
        self.vocabulary = Vocabulary(terms)
        self.idf = np.array([w for _, w in terms], dtype=np.float64)
        self.k = k
        made = [(i, y, np.array(f, dtype=np.int64), self._unit(np.array(f, dtype=np.int64), np.array(n))) for i, y, f, n in examples if f]
        # examples with the same strongest feature lie together, so that block maxima tell blocks apart
        made.sort(key=lambda e: (int(e[2][np.argmax(np.where(e[2] < len(terms) - 1, e[3], 0))]), e[1], e[0]))
        self.ids = np.array([e[0] for e in made], dtype=np.int64)
        self.labels = np.array([e[1] for e in made], dtype=np.float64)
        self.blocks = max(1, -(-len(made) // BLOCK))
        term = np.concatenate([e[2] for e in made]) if made else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(made)), [len(e[2]) for e in made]) if made else term
        weight = np.concatenate([e[3] for e in made]) if made else np.zeros(0)
        order = np.argsort(doc // BLOCK, kind="stable")
        self.term, self.doc, self.weight = term[order], doc[order] % BLOCK, weight[order]
        self.start = np.searchsorted(doc[order] // BLOCK, np.arange(self.blocks + 1))
        self.query = np.zeros(len(terms))
        slot = term * self.blocks + doc // BLOCK
        self.most = np.zeros(len(terms) * self.blocks)
        np.maximum.at(self.most, slot, weight)
        self.most = self.most.reshape(len(terms), self.blocks)
        self.calibration: tuple[list[float], list[float]] = ([0.0, 1.0], [0.0, 1.0])
        self.empty = 0.0

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[terms]
        return weights / np.linalg.norm(weights)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        terms, counts = self.vocabulary.sparse(text)
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0)
        own = np.array(terms)
        return own, self._unit(own, np.array(counts))

    def neighbours(self, terms: np.ndarray, weights: np.ndarray, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exactly the ``k`` examples with the largest cosine above zero, ties to the earlier example; ``but``: an id to leave out."""
        bounds = weights @ self.most[terms]
        self.query[terms] = weights
        at, cos, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in np.argsort(-bounds, kind="stable").tolist():
            if bounds[block] <= 0 or len(at) >= self.k and bounds[block] < least - 1e-12:
                break
            own = slice(self.start[block], self.start[block + 1])
            score = np.bincount(self.doc[own], self.query[self.term[own]] * self.weight[own], BLOCK)
            hit = np.flatnonzero(score >= max(least - 1e-12, 1e-12) if len(at) >= self.k else score > 0)
            if but is not None:
                hit = hit[self.ids[hit + block * BLOCK] != but]
            if not len(hit):
                continue
            at, cos = np.concatenate([at, hit + block * BLOCK]), np.concatenate([cos, score[hit]])
            best = np.lexsort((at, -np.round(cos, 12)))[: self.k]
            at, cos = at[best], cos[best]
            least = cos[-1]
        self.query[terms] = 0
        return at, cos

    def vote(self, terms: np.ndarray, weights: np.ndarray, but: int | None = None) -> tuple[float | None, list[int]]:
        """The distance-weighted share of toxic neighbours, and their ids; None without a feature or neighbour."""
        if not len(terms):
            return None, []
        at, cos = self.neighbours(terms, weights, but)
        if not len(at):
            return None, []
        pull = cos / (0.05 + 1 - np.minimum(cos, 1.0))
        return float((pull * self.labels[at]).sum() / pull.sum()), self.ids[at].tolist()

    def score(self, vote: float | None) -> float:
        """The calibrated rate; a slope of a thousandth keeps the order of votes within pooled rates."""
        return self.empty if vote is None else float(0.999 * np.interp(vote, *self.calibration) + 0.001 * vote)

    def calibrate(self, bins: list[tuple[int, int, int]]) -> None:
        """bins: bin of the vote (-1: none), examples, toxic ones. Rates are made to rise with the vote (pooled where they fall)."""
        pooled: list[list[float]] = []
        for bin_no, n, toxic in sorted(bins):
            if bin_no < 0:
                self.empty = toxic / n
                continue
            pooled.append([bin_no * n / BINS, n, toxic])
            while len(pooled) > 1 and pooled[-2][2] / pooled[-2][1] >= pooled[-1][2] / pooled[-1][1]:
                last = pooled.pop()
                pooled[-1] = [a + b for a, b in zip(pooled[-1], last)]
        if pooled:
            votes, rates = [v / n for v, n, _ in pooled], [toxic / n for _, n, toxic in pooled]
            self.calibration = ([-1e-9, *votes, 1 + 1e-9], [rates[0], *rates, rates[-1]])


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_examples: int = 20_000, max_terms: int = 4_000, least_docs: int = 8, least_z: float = 5.0, k: int = 15,
) -> Index:
    """An index of about ``max_examples`` labelled rows, chosen by a hash of their id.

    Document frequencies are those of all of ``docs``. Features are kept if ``least_docs`` examples have them and their label rate is ``least_z`` standard errors from the
    mean, the ``max_terms`` most telling at most. Rows with a null label or id are not used; of several labels of an id the largest counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg((F.max(label_col) > 0).cast("int").alias("y"))
    total = known.count()
    lot = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = scratch.save(known.where(lot < min(1.0, max_examples / max(total, 1))), "chosen")
    # about max_examples ids of eight bytes: the bound makes it safe to broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = scratch.save(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).repartition(F.col("id")), "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(seen)
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())], ["term", "n", "y"])
            seen.clear(), toxic.clear()
            return made

        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = features(text or "").keys()
                seen.update(own)
                if y:
                    toxic.update(own)
            if len(seen) > 200_000:
                yield out()
        if seen:
            yield out()

    n, y = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = min(max(y / n, 1e-6), 1 - 1e-6) if n else 0.5
    counted = texts.select("text", "y").mapInArrow(count, "term string, n long, y long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    z = (F.col("y") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    telling = counted.where(F.col("n") >= least_docs).withColumn("z", F.abs(z)).where(F.col("z") >= least_z)
    names = [r["term"] for r in telling.orderBy(F.desc("z"), "term").limit(max_terms).collect()]
    terms = _weighted(docs.select(F.col(text_col).cast("string").alias("text")), names)
    vocabulary = Vocabulary(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [vocabulary.sparse(x or "") for x in batch.column(1).to_pylist()]
            cols = [batch.column(0), batch.column(2), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "y", "terms", "counts"])

    examples = scratch.save(texts.select("id", "text", "y").mapInArrow(vectors, "id long, y int, terms array<int>, counts array<double>"), "vectors")
    index = Index(terms, [tuple(r) for r in examples.orderBy("id").collect()], k)  # max_examples rows

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for i, f, c in zip(*(batch.column(j).to_pylist() for j in (0, 2, 3))):
                own = np.array(f, dtype=np.int64)
                vote = index.vote(own, index._unit(own, np.array(c)), but=i)[0] if f else None
                out.append(-1 if vote is None else round(vote * BINS))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), batch.column(1)], ["bin", "y"])

    bins = examples.mapInArrow(left_out, "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y")).collect()  # BINS + 2 rows at most
    index.calibrate([tuple(b) for b in bins])
    return index


def _weighted(texts: DataFrame, names: list[str]) -> list[tuple[str, float]]:
    """Features with their inverse document frequency over all ``texts``, ``OTHER`` last with weight one."""
    vocabulary = Vocabulary([(t, 1.0) for t in [*names, OTHER]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(names) + 1, np.int64), 0
        for batch in slices(batches):
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen[vocabulary.sparse(text or "")[0]] += 1
        seen[-1] = rows  # OTHER's place holds the number of texts
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array(seen)], ["term", "n"])

    found = dict(texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect())  # max_terms rows
    n = found.get(len(names), 0)
    return [*((t, float(np.log((1 + n) / (1 + found.get(i, 0))) + 1)) for i, t in enumerate(names)), (OTHER, 1.0)]


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` (0 to 1), ``evidence`` (ids of the nearest examples, nearest first, five at most) for each row.

    Defined cases: null and empty texts, and texts without any kept feature, have the rate of such examples as score and no
    evidence; rows that repeat are scored singly; null ids are kept; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            made = [own.vote(*own.vector(t or "")) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([own.score(v) for v, _ in made], pa.float64()), pa.array([e[:5] for _, e in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "score", "evidence"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {kind}, score double, evidence array<bigint>").withColumnRenamed("id", id_col)
