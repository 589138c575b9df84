"""Importance resampling against plain counts, and what it is for."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import importance
from tests.llm.data import awkward, wide, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, width, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    runs = [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, target, share=10, least=20, width=1, buckets=10_000):
    source = [(i, *features(t, width, buckets)) for i, t, _ in rows]
    s = Counter(b for _, _, f in source for b in f)
    t = Counter(b for x in target for b in features(x, width, buckets)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    out = []
    for i, n, f in source:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(enough[: share * len(enough) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize(("width", "buckets", "share"), [(1, 10_000, 10), (2, 97, 50), (1, 500, 100)])
def test_like_plain_counts(spark, width, buckets, share):
    rows = awkward() + [(200 + i, words(random.Random(i), 30), "en") for i in range(60)]
    target = [words(random.Random(i), 40, "abxy") for i in range(20)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(wide(spark, rows), bench, share=share, width=width, buckets=buckets)
    want = brute(rows, target, share=share, width=width, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[4] is not None for r in want) > 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(wide(spark, []), none).count() == 0
    rows = [(i, words(random.Random(i), 25), "en") for i in range(20)]
    assert sorted(map(tuple, importance.resample(wide(spark, rows), none).collect()), key=key) == sorted(brute(rows, []), key=key)


def test_ties_go_to_the_smaller_id(spark):
    """Equal noise (null ids) and equal texts: equal scores, and every row has its rank."""
    rows = [(None, "word " * 30, "en")] * 10 + [(1, "word " * 30, "en")]
    bench = spark.createDataFrame([(1, "word")], "item_id long, text string")
    got = [r["rank"] for r in importance.resample(wide(spark, rows), bench, share=100).collect()]
    assert sorted(got) == list(range(1, 12))


def test_draws_what_resembles_the_target(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 60, "ab" if i % 10 else "xy"), "en") for i in range(300)]
    bench = spark.createDataFrame([(i, words(rng, 60, "xy")) for i in range(50)], "item_id long, text string")
    drawn = [r.doc_id for r in importance.resample(wide(spark, rows), bench).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 30 and sum(i % 10 == 0 for i in drawn) >= 27
