"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import spelling
from lectern.llm.common import Scratch, crc32
from tests.llm.data import awkward, wide

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One edit apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least_letters=5, least_count=3, ratio=2, damage=None):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_letters and c >= least_count}
    forms, out = {}, []
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        forms[w] = (others[0][1] if others and -others[0][0] >= ratio * n[w] else None, len(others))
    for w in n:
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n[w], forms[w][1], n[form] if form else None))
    return sorted(out)


@pytest.mark.parametrize("damage", [None, 5])
def test_like_all_pairs(spark, damage):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    rows = awkward() + [(100 + i, " ".join(rng.choice(stems[: 1 + i % 60]) for _ in range(200)).upper() + " 1Ünder×÷score_", "en") for i in range(40)]
    got = spelling.variants(wide(spark, rows), damage=damage)
    want = brute(rows, damage=damage)
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] is not None for r in want) > 20
    assert max(len(r[0]) for r in want) < 100


def test_chains_end_at_the_root(spark):
    """Each word has twice the occurrences of the one before and differs from it by one letter."""
    chain = ["aaaaa" + "b" * k for k in range(6)]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)), "en")]
    got = {r.word: (r.form, r.root) for r in spelling.variants(wide(spark, rows)).collect()}
    assert got == {w: (chain[k + 1] if k < 5 else None, chain[5]) for k, w in enumerate(chain)}


def test_ties_go_to_the_first_word(spark):
    rows = [(1, "abcde " * 3 + "abcdz " * 6 + "abcdé " * 6 + "abcdf " * 6, "en")]
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(wide(spark, rows)).collect()}
    assert got["abcde"] == ("abcdf", 3)


def test_empty_and_wordless(spark):
    assert spelling.variants(wide(spark, [])).count() == 0
    assert spelling.variants(wide(spark, [(1, None, None), (2, "", "en"), (3, "12 34 -", "en")])).count() == 0


def test_very_long_words(spark):
    word = "ab" * 100_000
    rows = [(i, word, "en") for i in range(6)] + [(10 + i, word[1:], "en") for i in range(3)]
    got = {len(r.word): len(r.root) for r in spelling.variants(wide(spark, rows)).collect()}
    assert got == {200_000: 200_000, 199_999: 200_000}


def test_one_edit():
    rng = random.Random(8)
    made = ["".join(rng.choice("aé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    assert all(spelling.one_edit(a, b) == near(a, b) for a in made for b in made)


def test_keys_are_those_of_the_shorter_words():
    for word in ("abcde", "ééabé", "aabbaa"):
        whole = lambda w: spelling.deletion_keys(w)
        for i in range(len(word)):
            short = word[:i] + word[i + 1 :]
            assert len(np.intersect1d(whole(word), whole(short))) >= 1
        assert len(whole(word)) == 1 + len({word[:i] + word[i + 1 :] for i in range(len(word))})


def test_colliding_keys_give_no_pairs(spark, monkeypatch):
    words = spark.createDataFrame([(1, "abcde"), (2, "abcdf"), (3, "xxxxx"), (4, "abced"), (5, "abcd")], "id long, word string")
    real = spelling.keys
    monkeypatch.setattr(spelling, "keys", lambda w: real(w).selectExpr("0L AS key", "id", "letters"))
    got = spelling.neighbours(words, Scratch(spark, "test-spelling"))
    assert sorted((r.u, r.v) for r in got.collect()) == [(1, 2), (1, 5), (2, 5), (4, 5)]
