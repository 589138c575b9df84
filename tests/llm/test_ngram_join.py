"""The n-gram join against counts of all pairs, near the threshold and in crowds."""

import random

import numpy as np
import pytest

from lectern.llm import near_copies, ngram_join
from tests.llm.data import awkward, wide, words
from tests.llm.test_dedup import key
from tests.llm.test_near_copies import brute, crowded, shingled


def grouped(sets, percent=80):
    """The smallest place that each set reaches over similar pairs, by one matrix of all pairs."""
    names = {}
    place = [np.array([names.setdefault(x, len(names)) for x in s], dtype=np.int64) for s in sets]
    has = np.zeros((len(sets), len(names)), dtype=np.float32)
    for i, p in enumerate(place):
        has[i, p] = 1
    common = (has @ has.T).astype(np.int64)
    sizes = np.array([len(s) for s in sets])
    near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    low = np.arange(len(sets))
    while True:
        new = np.where(near, low[None, :], len(sets)).min(axis=1)
        if (new == low).all():
            return low.tolist()
        low = new


def templated(start, copies, length, changed, seed):
    """Copies of a text of their own in each of which some words are changed."""
    rng = random.Random(seed)
    base = [f"{seed}{w}" for w in words(rng, length).split()]
    out = []
    for n in range(copies):
        text = list(base)
        for at in rng.sample(range(len(text)), changed):
            text[at] = f"x{seed}n{n}a{at}"
        out.append((start + n, " ".join(text), "en"))
    return out


#: copies, words, words changed in each: most pairs are close to the threshold
CROWDS = [(300, 400, 6), (500, 600, 8), (500, 300, 4), (300, 600, 8)]


def test_like_all_pairs(spark):
    rows = crowded()
    got = ngram_join.similar_documents(wide(spark, rows)).collect()
    want = [(i, len(shingled(t)), c if shingled(t) else i) for (i, t, _), c in zip(rows, brute(rows))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("percent", "width", "often", "part"), [(50, 2, 1, 64), (95, 3, 1000, 1 << 20)])
def test_other_parameters(spark, monkeypatch, percent, width, often, part):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = [r for r in crowded() if r[0] is not None]
    grams = lambda t: [tuple(w[i : i + width]) for w in [(t or "").encode().lower().split()] for i in range(max(1, len(w) - width + 1)) if w]
    sets = [set(grams(t)) for _, t, _ in rows]
    got = ngram_join.similar_documents(wide(spark, rows), percent=percent, width=width).collect()
    low = grouped(sets, percent)
    least = {}
    for (i, _, _), k in zip(rows, low):
        least[k] = min(i, least.get(k, i))
    want = [(i, len(s), least[k] if s else i) for (i, _, _), s, k in zip(rows, sets, low)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_crowds_near_the_threshold(spark):
    """No link is lost in cells of hundreds of sets, whatever the blocks; near copies are the same groups."""
    rows, want = [], {}
    for k, (copies, length, changed) in enumerate(CROWDS):
        own = templated(10_000 * k, copies, length, changed, k)
        for i, low in enumerate(grouped([shingled(t) for _, t, _ in own])):
            want[own[i][0]] = own[low][0]
        rows += own
    assert 200 < len(set(want.values())) < 1000
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(wide(spark, rows)).collect()}
    assert got == want
    stage = near_copies.near_copies(wide(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in stage} == want
    assert sum(r.kept for r in stage) == len(set(want.values()))


def test_empty_table(spark):
    assert ngram_join.similar_documents(wide(spark, [])).count() == 0


def test_empty_sets_are_alone(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " \t", "en"), (4, "a b", "en"), (5, "A  b", "en")]
    got = ngram_join.similar_documents(wide(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_parts_of_a_long_text_are_one(monkeypatch):
    text = " ".join(awkward()[i][1] for i in range(40)).encode()
    whole = [ngram_join.shingles(text, w) for w in (1, 3, 5)]
    monkeypatch.setattr(ngram_join, "PART", 7)
    assert all((ngram_join.shingles(text, w) == x).all() for w, x in zip((1, 3, 5), whole))
    assert len(ngram_join.shingles(b"one two", 5)) == 1 == len(ngram_join.shingles(b"  one", 5)) and not len(ngram_join.shingles(b" \n ", 5))
