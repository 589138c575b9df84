"""Writes and reads of partitioned folders."""

import json

from lectern.sources import providers, sinks

SCHEMA = "project string, id string, version long, body string"


def read(spark, folder):
    return sorted((r.project, r.id, r.version, r.body) for r in spark.read.parquet(folder).collect())


def test_append_upsert_delete(spark, tmp_path):
    folder, staged, rest = (str(tmp_path / n) for n in ("a", "b", "c"))
    old = [("p", "1", 1, "x"), ("p", "2", 1, "y"), ("q", "3", 1, "z")]
    sinks.append(spark.createDataFrame(old, SCHEMA), folder, "project")
    new = spark.createDataFrame([("p", "2", 2, "new"), ("p", "4", 1, "w")], SCHEMA)
    for _ in range(2):  # an upsert again changes nothing
        sinks.upsert(spark, new, folder, staged, "project", "id", "version")
        assert read(spark, folder) == [("p", "1", 1, "x"), ("p", "2", 2, "new"), ("p", "4", 1, "w"), ("q", "3", 1, "z")]
    sinks.delete(spark, folder, rest, spark.createDataFrame([("p",)], "project string"), "project")
    assert read(spark, rest) == [("q", "3", 1, "z")]


def test_trace_lines(spark, tmp_path):
    sinks.trace(spark.createDataFrame([(1, None), (2, "x")], "n long, note string"), str(tmp_path / "t"), "svc")
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert [json.loads(x) for x in lines] == [{"service": "svc", "n": 1}, {"service": "svc", "n": 2, "note": "x"}]


def test_hash_embeddings(spark):
    rows = spark.createDataFrame([("a b",), ("b A",), ("",), (None,)], "t string")
    got = [r.e for r in rows.select(providers.HashEmbeddings(8).embed(rows.t).alias("e")).collect()]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-6 or got[0] == [0.0] * 8
    assert got[2] == got[3] == [0.0] * 8
