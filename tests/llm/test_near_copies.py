"""The pipeline's near copies against brute force over all pairs."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lectern.llm import near_copies, ngram_join
from tests.llm.data import awkward, wide, words
from tests.llm.test_dedup import key


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute(rows):
    """The smallest id that each row reaches over pairs of similarity 0.8 or more."""
    sets, low = [shingled(t) for _, t, _ in rows], [i for i, _, _ in rows]
    near = [[m for m, b in enumerate(sets) if a == b or len(a & b) / len(a | b) >= 0.8] for a in sets]
    while True:
        new = [min((low[m] for m in ms if low[m] is not None), default=None) for ms in near]
        if new == low:
            return low
        low = new


def crowded():
    """Copies with changes in a few words or in many, one crowd of them, and different texts around one long common line."""
    rng, line = random.Random(3), words(random.Random(4), 60)
    rows = awkward()
    for n in range(25):
        base = words(rng, 200).split()
        for k in range(4):
            changed = list(base)
            for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 6, 12])):
                changed[at] = f"w{n}x{k}"
            rows.append((1000 + 10 * n + k, " ".join(changed), "en"))
    base = words(rng, 150).split()
    for n in range(50):
        changed = list(base)
        changed[rng.randrange(150)] = f"v{n}"
        rows.append((2000 + n, " ".join(changed), "en"))
    rows += [(3000 + n, f"{line} {words(rng, 30)}", "en") for n in range(50)]
    return rows


@pytest.mark.parametrize("block", [100, 1 << 16])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = crowded()
    got = near_copies.near_copies(wide(spark, rows)).select("doc_id", "component_id").collect()
    want = [(i, c) for (i, _, _), c in zip(rows, brute(rows))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert near_copies.near_copies(wide(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    """Repeated ids with other texts and null ids included."""
    text = words(random.Random(8), 100)
    rows = crowded() + [(7000, text, "en"), (7001, text + " tail", "en"), (7001, "another text of its own", "en"), (None, text + " end", "en")]
    rows += [(None, words(random.Random(10), 90) + end, "en") for end in ("", " one", " two")]
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, wide(spark, rows), "").collect())
    low = brute(rows)
    groups = {}
    for (i, t, _), c in zip(rows, low):
        if c is not None:
            groups.setdefault(c, set()).add((i, t))
            assert (kept[i, t] > 0) <= (i == c)
    assert all(sum(kept[x] > 0 for x in own) == 1 for own in groups.values())
    assert kept[7001, "another text of its own"] == 1 and sum(n for (i, _), n in kept.items() if i is None) == 1
    assert sum(kept.values()) == sum(1 for (i, t, _) in rows if kept[i, t])


def test_exact_stage_with_null_and_repeated_ids(spark):
    rows = [(1, "Same", "en"), (2, "same", "en"), (None, "same", "en"), (3, "other", "en"), (2, "apart", "en"), (None, None, "en"), (None, "lone", "en")]
    kept = corpus_pipeline.without_copies(spark, wide(spark, rows), "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(2, "same"), (3, "other"), (2, "apart"), (None, None), (None, "lone")])
