"""The stored index: changes against a rebuilt index, and against plain BM25."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical, search_index
from lectern.operators.search_index import SearchIndex
from lectern.sources import shared

SCHEMA = "project_id string, paper_id string, full_text string"


def made(n, seed=1, length=40):
    rng = random.Random(seed)
    return [(f"p{i % 3}", str(i), " ".join(rng.choice("abcdefghij") * rng.choice((1, 1, 2)) for _ in range(rng.randint(1, length)))) for i in range(n)]


def index_of(spark, rows):
    out = SearchIndex(spark, shared.new_folder(spark, "test-index"), buckets=4)
    out.add(spark.createDataFrame(rows, SCHEMA))
    return out


def found(index, question, k, per_key=False):
    return sorted(map(tuple, index.search(question, k, per_key).collect()))


def plain(spark, rows, question, k, *keys):
    docs = spark.createDataFrame(rows, SCHEMA).select(F.coalesce("project_id", F.lit("")).alias("project_id"), "paper_id", "full_text")
    best = lexical.top(lexical.bm25(docs, question, "paper_id", "full_text", *keys), k, *keys)
    key = {str(r[1]): r[0] or "" for r in rows}
    return sorted((key[r.id], r.id, r.score, r["rank"]) for r in best.collect())


@pytest.mark.parametrize("k", [1, 7, 500])
def test_like_plain_bm25(spark, monkeypatch, k):
    """Parts of four documents, so that most are left out by their bounds when ``k`` is small."""
    monkeypatch.setattr(search_index, "PART_BITS", 2)
    rows = made(200) + [("p0", "200", None), (None, "201", "aa b"), ("p1", "202", "")]
    index = index_of(spark, rows)
    for question in ("aa b c", "a a jj", "zz", ""):
        assert found(index, question, k) == plain(spark, rows, question, k)
    assert found(index, "aa b c", k, per_key=True) == plain(spark, rows, "aa b c", k, "project_id")


def test_changes_like_a_rebuilt_index(spark):
    rows, more, again = made(120), [("p1", "500", "a b"), ("p9", "501", "jj jj")], made(40, seed=9)
    index = index_of(spark, rows)
    index.add(spark.createDataFrame(more, SCHEMA))
    index.add(spark.createDataFrame(again, SCHEMA))  # in the place of the first forty
    index.delete(spark.createDataFrame([("p2",)], "key string"))
    index.delete(spark.createDataFrame([("p0", "60"), ("p0", "61")], "key string, id string"))
    index.delete(spark.createDataFrame([("unknown",)], "key string"))
    left = {(p, i): t for p, i, t in rows + more + again if p != "p2" and (p, i) != ("p0", "60")}
    rebuilt = index_of(spark, [(p, i, t) for (p, i), t in left.items()])
    wanted = [found(rebuilt, q, 25, per) for q in ("a b jj", "cc d") for per in (False, True)]
    assert [found(index, q, 25, per) for q in ("a b jj", "cc d") for per in (False, True)] == wanted
    assert len(index.state().segments) == 3 and len(index.state().gone) == 3
    index.merge()
    assert len(index.state().segments) == 1 and not index.state().gone
    assert [found(index, q, 25, per) for q in ("a b jj", "cc d") for per in (False, True)] == wanted
    assert index.documents().count() == len(left)
    index.add(spark.createDataFrame([("p2", "700", "new b")], SCHEMA))
    assert [r[1] for r in found(index, "new", 5)] == ["700"]


def test_unfinished_changes_are_not_seen(spark):
    """Tables without a record are no part of the index, and a version is taken once."""
    index = index_of(spark, made(30))
    before = found(index, "a b", 10)
    docs = index.documents().select("key", "id", "dl")
    index._segment(docs.where("id < '2'"), docs.select("key", "id", F.lit("a").alias("term"), F.lit(9).cast("long").alias("tf")))
    assert found(index, "a b", 10) == before
    old = index.state()
    index.add(spark.createDataFrame([("p0", "900", "a")], SCHEMA))
    with pytest.raises(Exception, match="(?i)exists"):
        index._commit(old, None, None, [])


def test_repeated_ids_are_refused(spark):
    with pytest.raises(ValueError, match="unique"):
        index_of(spark, [("p", "1", "a"), ("p", "1", "b")])
    assert found(index_of(spark, [("p", "1", "a"), ("q", "1", "b"), ("p", None, "a")]), "a", 5) == [("p", "1", pytest.approx(0.693147, abs=1e-5), 1)]


def test_empty_index(spark):
    index = SearchIndex(spark, shared.new_folder(spark, "test-index"))
    assert index.search("a", 3).count() == 0 and index.search("a", 3, per_key=True).count() == 0
    index.delete(spark.createDataFrame([("p",)], "key string"))
    index.merge()
    assert not index.state().version


def test_reads_the_words_of_the_question_only(spark):
    """One scan, of the folders and terms asked for."""
    index = index_of(spark, made(60))
    plan = index.search("aa", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "PartitionFilters" in plan and "bucket" in plan and ("EqualTo(term,aa)" in plan or "In(term" in plan)


def test_table_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(10).write.parquet(path)
    one = shared.version_of(spark.read.parquet(path))
    assert one == shared.version_of(spark.read.parquet(path))
    spark.range(3).write.mode("append").parquet(path)
    assert shared.version_of(spark.read.parquet(path)) != one
