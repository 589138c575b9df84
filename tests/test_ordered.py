"""Numbers and bins in order, against plain loops over each key."""

import random

import pytest

from lectern.operators import ordered, review
from lectern.sources.providers import Extracts


def bin_loop(lengths, limit):
    out, number, fill = [], -1, None
    for n in lengths:
        if n > limit:
            number, fill = number + 1, None
        elif fill is None or fill + n > limit:
            number, fill = number + 1, n
        else:
            fill += n
        out.append((number, n > limit))
    return out


def items(seed, n, keys=3, longest=40):
    rng = random.Random(seed)
    rows = [(None if keys and i % 17 == 0 else f"k{rng.randrange(keys) if rng.random() < 0.4 else 0}", i, rng.choice([0, 0, 1, 3, 7, 20, 30, 31, longest])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("bits", "limit"), [(0, 30), (2, 30), (4, 100), (12, 30), (3, 0)])
def test_bins(spark, monkeypatch, bits, limit):
    """Slices of one row to more than all rows; items over the limit, empty items, null keys."""
    monkeypatch.setattr(ordered, "SLICE_BITS", bits)
    rows = items(bits, 300)
    got = ordered.bins(spark.createDataFrame(rows, "key string, n long, len int"), "key", "n", "len", limit).collect()
    want = []
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key) if key else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        want += [(*r, *b) for r, b in zip(own, bin_loop([r[2] for r in own], limit))]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_bins_of_nothing(spark):
    assert ordered.bins(spark.createDataFrame([], "key string, n long, len int"), "key", "n", "len", 5).count() == 0
    one = ordered.bins(spark.createDataFrame([("a", 1, None)], "key string, n long, len int"), "key", "n", "len", 5).collect()
    assert list(map(tuple, one)) == [("a", 1, None, 0, False)]


@pytest.mark.parametrize("bits", [0, 3])
def test_numbers(spark, monkeypatch, bits):
    monkeypatch.setattr(ordered, "SLICE_BITS", bits)
    rows = items(9, 200)
    got = ordered.numbered(spark.createDataFrame(rows, "key string, n long, len int").repartition(5), "key", "n").collect()
    seen = {}
    want = []
    for r in sorted(rows, key=lambda r: r[1]):
        want.append((*r, seen.setdefault(r[0], 0)))
        seen[r[0]] += 1
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def summary_loop(texts, limit, longest=200):
    """Rounds of bins and summaries of the texts of one key."""
    while True:
        joined = {}
        for t, (b, _) in zip(texts, bin_loop([len(t) for t in texts], limit)):
            joined.setdefault(b, []).append(t)
        texts = []
        for b in sorted(joined):
            head = "\n".join(joined[b])[:longest]
            end = max(head.rfind(c) for c in ".!?")
            texts.append(head[: end + 1] if end >= 0 else head)
        if len(texts) == 1:
            return texts[0]


def test_summaries_in_rounds(spark):
    """Several rounds, with one key of many parts, and bins that hold few of them."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "", ".", "?"]) for _ in range(rng.randint(0, 90)))
    rows = [("hot" if i % 5 else f"k{i % 3}", i, text()) for i in range(150)] + [("long", 1000, "x" * 5000), ("none", 1001, None)]
    got = review.combined(spark.createDataFrame(rows, "source string, arrival long, abstract string"), "source", "arrival", "abstract", 450, Extracts())
    want = {k: summary_loop([t or "" for s, _, t in rows if s == k], 450) for k in {r[0] for r in rows}}
    assert {r.source: r.summary for r in got.collect()} == want


def test_summaries_that_do_not_shrink(spark):
    rows = [("k", i, "x" * 100) for i in range(4)]
    with pytest.raises(ValueError, match="no fewer"):
        review.combined(spark.createDataFrame(rows, "source string, arrival long, abstract string"), "source", "arrival", "abstract", 100, Extracts()).count()
