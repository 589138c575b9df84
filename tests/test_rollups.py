"""Sums that a stream adds to once, sketches that roll up, and the report that stands in."""

import os
import random
import time

import pytest

from lectern.operators import review, usage
from lectern.sources import shared
from lectern.sources.sinks import RollUp
from lectern.streaming import streams


def rollup(spark):
    return RollUp(spark, shared.new_folder(spark, "test-rollup"), {"k": "string"}, {"n": "long", "v": "double"})


def total(r):
    return sorted(map(tuple, r.read().collect()))


def test_batches_count_once(spark):
    r = rollup(spark)
    rows = lambda *x: spark.createDataFrame(x, "k string, n long, v double")
    assert total(r) == []
    r.compact()
    r.add(rows(("a", 1, 0.5), ("a", 2, 0.5), (None, 1, 1.0)), 0)
    r.add(rows(("b", 5, 2.0)), 1)
    want = [("a", 3, 1.0), ("b", 5, 2.0), (None, 1, 1.0)]
    key = lambda x: str(x[0])
    assert sorted(r.read().collect(), key=key) == sorted(want, key=key)
    r.add(rows(("b", 5, 2.0)), 1)  # again after a failure
    assert sorted(r.read().collect(), key=key) == sorted(want, key=key)
    r.compact()
    r.add(rows(("a", 1, 0.5), ("a", 2, 0.5), (None, 1, 1.0)), 0)  # older than the base
    assert sorted(r.read().collect(), key=key) == sorted(want, key=key) and r.upto() == 1
    r.add(rows(("a", 1, 1.0)), 2)
    r.compact()
    again = RollUp(spark, r.folder, r.keys, r.sums)
    assert ("a", 4, 2.0) in again.read().collect() and again.upto() == 2


def test_stream_that_fails_in_a_batch(spark, tmp_path):
    """The second batch fails after its sums are written; the stream starts again and every row counts once."""
    source = tmp_path / "in.parquet"
    os.makedirs(source)
    for n in range(4):
        spark.createDataFrame([("a", n, 1.0), (f"k{n}", 1, 1.0)], "k string, n long, v double").coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        name = next(f for f in os.listdir(tmp_path / f"p{n}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"p{n}" / name, source / f"{n}.parquet")
        os.utime(source / f"{n}.parquet", (time.time() + n, time.time() + n))
    stream = lambda: spark.readStream.schema("k string, n long, v double").option("maxFilesPerTrigger", 1).parquet(str(source))
    r, add = rollup(spark), RollUp.add

    def failing(batch, number):
        add(r, batch, number)
        if number == 1:
            raise RuntimeError("lost")

    r.add = failing
    with pytest.raises(Exception, match="lost"):
        streams.added_to(r, stream())
    r.add = lambda batch, number: add(r, batch, number)
    streams.added_to(r, stream())
    streams.added_to(r, stream())  # nothing new
    assert total(r) == [("a", 6, 4.0), ("k0", 1, 1.0), ("k1", 1, 1.0), ("k2", 1, 1.0), ("k3", 1, 1.0)]


def test_sketches_merge_like_all_values(spark):
    rng = random.Random(2)
    values = [(f"d{i % 7}", int(rng.expovariate(1 / 300))) for i in range(20_000)] + [("d0", None)]
    calls = spark.createDataFrame(values, "day string, latency_ms long")
    merged = usage.merged_sketches(usage.latency_sketches(calls, "day"))
    found = {r.share: (r.n, r.latency_ms) for r in usage.latency_quantiles(merged, 0.1, 0.5, 0.95).collect()}
    every = sorted(v for _, v in values if v is not None)
    for share, (n, v) in found.items():
        below, upto = sum(x < v for x in every) / n, sum(x <= v for x in every) / n
        assert n == 20_000 and below - 0.02 <= share <= upto + 0.02
    assert usage.latency_sketches(calls.where("latency_ms < 0"), "day").count() == 0


def test_fallback_report(spark):
    texts = [("t", 1, "# A heading\n\nOne.\nTwo.\n  \nThree.\nFour."), ("t", 2, "Title: Named \nx" + "y" * 600), ("t", 3, None), (None, 4, "lone")]
    texts += [("t", 10 + n, f"text {n}") for n in range(9)]
    got = {r.topic: (r.n, r.synthesis) for r in review.fallback(spark.createDataFrame(texts, "topic string, n_ long, body string"), "topic", "n_", "body").collect()}
    n, report = got["t"]
    assert n == 12 and report.startswith("# Literature Review: t\n\n## Overview\n\nThis literature review covers 12 papers on the topic of t. Due")
    assert "### A heading\n\nOne. Two. Three....\n\n### Named\n\nTitle: Named  x" in report
    assert "### Paper 3\n\n### Paper 4\n\ntext 0...\n\n" in report and "text 6..." in report and "text 7" not in report
    assert "\n*Note: 2 additional papers" in report and report.endswith("individual paper analyses above.")
    assert "y" * 484 in report and "y" * 486 not in report
    assert got[None][0] == 1 and "### Paper 1\n\nlone..." in got[None][1] and "Note" not in got[None][1]


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return self

        def get(self, key, default):
            return default

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.base_folder(Session())
