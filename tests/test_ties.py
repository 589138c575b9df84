"""Rankings of copies: which of them are taken, and how they are ranked, at the last place of a list."""

import duckdb
import pytest

from lectern.plans import catalog
from tests.compare import rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Eighty copies share the first places: by number 1, 2, 4, ... are first, by text 1, 10, 100, ..."""
    out = str(tmp_path_factory.mktemp("ties"))
    copies = [(n, "the with from which", "src0") if n % 3 else (n, f"a text {n}", "src1") for n in range(120)]
    spark.createDataFrame(copies, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{out}/documents.parquet")
    vectors = [(n, [float(n % 5), 1.0, float(n % 11)], n % 10) for n in range(120)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", ["hybrid_rrf", "hybrid_weighted_rrf", "heuristic_rerank"])
def test_ties_at_the_last_place(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    want = con.sql(catalog.ORACLE[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
