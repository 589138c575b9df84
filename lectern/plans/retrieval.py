"""Retrieval queries: lexical, vector and hybrid search, dedup, context packing, chunks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import chunking, hybrid, lexical, records, vectors
from lectern.operators.forest import Forest
from lectern.operators.search_index import SearchIndex
from lectern.plans.registry import query
from lectern.sources import shared, tables
from lectern.sources.tables import with_views

QUESTION = "the with from which with"
TERMS = "(VALUES ('the', 1), ('with', 2), ('from', 1), ('which', 1)) AS q(term, times)"
WORDS = r"list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"

BM25 = rf"""words AS (SELECT paper_id AS id, project_id, {WORDS.format("full_text")} AS w FROM papers),
    lens AS (SELECT id, project_id, len(w) AS dl FROM words),
    tf AS (SELECT id, project_id, term, count(*) AS tf FROM (SELECT id, project_id, unnest(w) AS term FROM words) GROUP BY ALL),
    corpus AS (SELECT count(*) AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM lens),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm25 AS (SELECT tf.id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tf JOIN {TERMS} USING (term) JOIN df USING (term) JOIN lens USING (id), corpus GROUP BY tf.id)"""
COSINE = """round(list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_inner_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))
    * list_inner_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))), 6)"""


def paper_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The stored index of a folder's papers; made when first asked for, and again when the table's files change."""
    docs = tables.load(spark, folder, "documents")
    index = SearchIndex(spark, f"{shared.base_folder(spark)}/papers-index-{shared.version_of(docs)}")
    if not index.state().version:
        try:
            index.add(tables.papers(spark, folder))
        except AnalysisException:  # another session may have been first
            if not index.state().version:
                raise
    return index


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose number is divisible by 50, as a query."""
    chosen = tables.load(spark, folder, "embeddings").where("vec_id % 50 = 0")
    return chosen.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return tables.load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("bigint").alias("kind"), (1 + F.col("label") / 10).alias("weight"))


@query(with_views(rf"""WITH words AS (SELECT paper_id AS id, {WORDS.format("full_text")} AS w FROM papers),
    tf AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(w) AS term FROM words)), n AS (SELECT count(*) AS n FROM words)
    SELECT term, count(*) AS df, round(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM tf, n GROUP BY term""", "papers"))  # fmt: skip
def corpus_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = lexical.term_stats(tables.papers(spark, folder), "paper_id", "full_text")
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(with_views(f"""WITH {BM25} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25
    ORDER BY score DESC, id LIMIT 20""", "papers"))  # fmt: skip
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return paper_index(spark, folder).search(QUESTION, 20).select("id", "score", "rank")


@query(with_views(rf"""WITH words AS (SELECT paper_id AS id, project_id, {WORDS.format("abstract")} AS w FROM papers),
    lens AS (SELECT id, project_id, len(w) AS dl FROM words),
    tf AS (SELECT id, project_id, term, count(*) AS tf FROM (SELECT id, project_id, unnest(w) AS term FROM words) GROUP BY ALL),
    corpus AS (SELECT project_id, count(*) AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM lens GROUP BY project_id),
    df AS (SELECT project_id, term, count(*) AS df FROM tf GROUP BY project_id, term),
    bm25 AS (SELECT tf.project_id, tf.id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tf JOIN {TERMS} USING (term) JOIN df USING (project_id, term) JOIN lens USING (project_id, id) JOIN corpus USING (project_id) GROUP BY ALL),
    r AS (SELECT project_id, id, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) AS rank FROM bm25)
    SELECT * FROM r WHERE rank <= 5""", "papers"))  # fmt: skip
def bm25_per_source(spark: SparkSession, folder: str) -> DataFrame:
    best = paper_index(spark, folder).search(QUESTION, 5, per_key=True)
    return best.select(F.col("key").alias("project_id"), "id", "score", "rank")


CHANGED = f"""changed AS (SELECT paper_id, project_id, CASE WHEN arrival % 7 = 0 THEN title ELSE full_text END AS full_text FROM papers WHERE project_id <> 'src3' AND arrival % 11 <> 5)"""


@query(with_views(f"""WITH {CHANGED}, {BM25.replace("FROM papers", "FROM changed")}, best AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25)
    SELECT state, best.* FROM best, (VALUES ('segments'), ('merged')) s(state) WHERE rank <= 50""", "papers"))  # fmt: skip
def index_upkeep(spark: SparkSession, folder: str) -> DataFrame:
    """Searches of an index after additions, replacements and deletions, and again after the merge of its segments."""
    papers = tables.papers(spark, folder)
    index = SearchIndex(spark, shared.new_folder(spark, "upkeep-index"))
    index.add(papers.where("arrival % 2 = 0"))
    index.add(papers.where("arrival % 2 = 1"))
    index.add(papers.where("arrival % 7 = 0").withColumn("full_text", F.col("title")))
    index.delete(papers.where("project_id = 'src3'").select(F.col("project_id").alias("key")))
    index.delete(papers.where("arrival % 11 = 5").select(F.col("project_id").alias("key"), F.col("paper_id").alias("id")))
    before = index.search(QUESTION, 50).withColumn("state", F.lit("segments"))
    index.merge()
    after = index.search(QUESTION, 50).withColumn("state", F.lit("merged"))
    return before.unionByName(after).select("state", "id", "score", "rank")


SCORED = f"""scored AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {COSINE.format("e.embedding", "q.embedding")} AS score
    FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"""


@query(f"""WITH {SCORED} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10""")
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.nearest(_vectors(spark, folder), _questions(spark, folder), 10)


@query(f"""WITH {SCORED} SELECT query_id, id, CAST(label AS BIGINT) AS kind, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM scored WHERE label IN (1, 3, 5) AND score >= 0.05 QUALIFY rank <= 10""")  # fmt: skip
def knn_filtered(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _vectors(spark, folder).where(F.col("kind").isin(1, 3, 5))
    found = vectors.nearest(kinds, _questions(spark, folder), 10, least=0.05)
    return found.join(kinds.select("id", "kind"), "id").select("query_id", "id", "kind", "score", "rank")


def vector_forest(spark: SparkSession, folder: str) -> Forest:
    """The stored forest over a folder's vectors; made when first asked for, and again when the table's files change."""
    known = tables.load(spark, folder, "embeddings")
    path = f"{shared.base_folder(spark)}/vector-forest-{shared.version_of(known)}"
    forest = Forest(spark, path)
    if not shared.exists(spark, f"{path}/entries/_SUCCESS"):
        forest.build(_vectors(spark, folder).withColumnRenamed("kind", "key"))
    return forest


@query()
def knn_forest(spark: SparkSession, folder: str) -> DataFrame:
    """What ``knn_filtered`` asks for, approximately: every fiftieth vector against those of three kinds. Scores are exact."""
    known = _vectors(spark, folder).withColumnRenamed("kind", "key")
    return vector_forest(spark, folder).nearest(known, _questions(spark, folder), 10, keys=["1", "3", "5"], least=0.05)


@query(f"""WITH {SCORED}, s AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20)
    SELECT query_id, id, round(score * (1 + label / 10), 7) AS weighted, row_number() OVER (PARTITION BY query_id ORDER BY round(score * (1 + label / 10), 7) DESC, id) AS rank
    FROM s QUALIFY rank <= 10""")  # fmt: skip
def knn_weighted(spark: SparkSession, folder: str) -> DataFrame:
    known = _vectors(spark, folder)
    found = vectors.nearest(known, _questions(spark, folder), 20).drop("rank").join(known.select("id", "weight"), "id")
    # six decimals times one: rounding to seven meets no tie
    weighted = found.select("query_id", "id", F.round(F.col("score") * F.col("weight"), 7).alias("weighted"))
    return lexical.top(weighted, 10, "query_id", score="weighted")


HYBRID = f"""{BM25}, {SCORED},
    best AS (SELECT CAST(id AS BIGINT) AS id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 ORDER BY score DESC, id LIMIT 20),
    lex AS (SELECT vec_id AS query_id, best.* FROM best, embeddings WHERE vec_id % 50 = 0),
    vec AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 20),
    f AS (SELECT coalesce(lex.query_id, vec.query_id) AS query_id, coalesce(lex.id, vec.id) AS id, coalesce(vec.score, 0.0) AS vector_score, coalesce(lex.score, 0.0) AS bm25_score,
        round(coalesce({{0}} / (60 + vec.rank), 0) + coalesce({{1}} / (60 + lex.rank), 0), 6) AS rrf_score FROM lex FULL JOIN vec ON lex.query_id = vec.query_id AND lex.id = vec.id)"""
FIRST_TEN = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM f QUALIFY rank <= 10"


def _hybrid_sql(vector_weight: str, bm25_weight: str) -> str:
    return HYBRID.replace("{0}", vector_weight).replace("{1}", bm25_weight)


def _fusion(spark: SparkSession, folder: str, vector_weight: float, bm25_weight: float) -> DataFrame:
    """Rankings of twice the wanted length, fused for each query vector; the question's words are the same. Documents and vectors share their numbers."""
    asked = _questions(spark, folder)
    best = hybrid.numbered_ties(paper_index(spark, folder).candidates(QUESTION, 20), 20)
    # one row: the list of twenty
    listed = best.agg(F.collect_list(F.struct(F.col("id").cast("bigint").alias("id"), "score", "rank")).alias("best"))
    lexical_top = asked.select("query_id").crossJoin(F.broadcast(listed)).select("query_id", F.inline("best"))
    vector_top = vectors.nearest(_vectors(spark, folder), asked, 20)
    return hybrid.fused({"vector": (vector_top, vector_weight), "bm25": (lexical_top, bm25_weight)}, "query_id")


@query(with_views(f"WITH {_hybrid_sql('1.0', '1.0')} {FIRST_TEN}", "papers"))
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.top(_fusion(spark, folder, 1.0, 1.0), 10, "query_id", score="rrf_score")


@query(with_views(f"WITH {_hybrid_sql('0.7', '0.3')} {FIRST_TEN}", "papers"))
def hybrid_weighted_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.top(_fusion(spark, folder, 0.7, 0.3), 10, "query_id", score="rrf_score")


@query(with_views(f"""WITH {_hybrid_sql('1.0', '1.0')},
    c AS (SELECT f.*, lower(abstract) AS low FROM f JOIN papers ON papers.arrival = f.id),
    h AS (SELECT query_id, id, rrf_score, round(least(1.0, rrf_score * 0.6 + (CAST(contains(low, 'the') AS INT) + CAST(contains(low, 'with') AS INT)
        + CAST(contains(low, 'from') AS INT) + CAST(contains(low, 'which') AS INT)) / 4 * 0.25 + 0.1
        + CASE WHEN contains(low, 'the with from which with') THEN 0.1 ELSE 0.0 END * 0.05), 6) AS rerank_score FROM c)
    SELECT *, round(rrf_score * 0.4 + rerank_score * 0.6, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score * 0.4 + rerank_score * 0.6, 6) DESC, id) AS rank
    FROM h QUALIFY rank <= 10""", "papers"))  # fmt: skip
def heuristic_rerank(spark: SparkSession, folder: str) -> DataFrame:
    found = _fusion(spark, folder, 1.0, 1.0).select("query_id", "id", "rrf_score")
    docs = tables.papers(spark, folder).select(F.col("arrival").alias("id"), "abstract")
    scored = docs.join(found, "id")
    again = hybrid.heuristic_score(QUESTION, F.col("abstract"), F.col("rrf_score"), F.lit(1.0))
    scored = scored.select("query_id", "id", "rrf_score", F.round(again, 6).alias("rerank_score"))
    scored = scored.withColumn("final_score", F.round(hybrid.combined(F.col("rrf_score"), F.col("rerank_score")), 6))
    return lexical.top(scored, 10, "query_id", score="final_score")


@query(r"""WITH a AS (SELECT conv_id, turn, string_split(trim(CASE WHEN turn % 3 = 0 THEN '0.9' || chr(10) || 'bad' || chr(10) || '2' ELSE CAST(length(text) / 1000.0 AS VARCHAR) END), chr(10)) AS l FROM conversations)
    SELECT conv_id, turn, i AS place, CASE WHEN TRY_CAST(trim(l[i + 1]) AS DOUBLE) IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, TRY_CAST(trim(l[i + 1]) AS DOUBLE))) END AS score FROM a, range(0, 5) t(i)""")
def rerank_parse_scores(spark: SparkSession, folder: str) -> DataFrame:
    talk = tables.load(spark, folder, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, "0.9\nbad\n2").otherwise((F.length("text") / 1000.0).cast("string"))
    scores = talk.select("conv_id", "turn", F.posexplode(hybrid.parsed_scores(answer, F.lit(5))).alias("place", "score"))
    return scores.withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {SCORED}, b AS (SELECT query_id, id, CAST(label AS BIGINT) AS paper, score FROM scored WHERE id <> query_id
        QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) = 1)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 5""")  # fmt: skip
def similar_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunk of each of the five papers nearest to each query's, its own left out; labels stand for papers."""
    chunks = _vectors(spark, folder).withColumnRenamed("kind", "paper")
    return vectors.nearest(chunks, _questions(spark, folder), 5, per="paper", others_only=True)


@query(with_views(f"""WITH {BM25},
    t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 ORDER BY score DESC, id LIMIT 20),
    e AS (SELECT rank, '[Source ' || rank || ': ' || title || ' (abstract)]' || chr(10) || abstract AS entry FROM t JOIN papers ON papers.paper_id = t.id),
    u AS (SELECT *, sum(length(entry)) OVER (ORDER BY rank) AS upto FROM e)
    SELECT 'all' AS query, count(*) AS entries, CAST(max(upto) AS BIGINT) AS n_chars, md5(string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM u WHERE upto <= 12000 HAVING count(*) > 0""", "papers"))  # fmt: skip
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.papers(spark, folder)
    best = paper_index(spark, folder).search(QUESTION, 20).select(F.col("id").alias("paper_id"), "rank")
    ranked = docs.join(F.broadcast(best), "paper_id").withColumn("query", F.lit("all"))  # twenty rows
    entry = F.concat(F.format_string("[Source %d: %s (abstract)]\n", "rank", "title"), "abstract")
    out = hybrid.packed_context(ranked, "query", "rank", entry, 12_000)
    return out.select("query", "entries", "n_chars", F.md5("context").alias("context_md5"))


DEDUP = """d AS (SELECT *, lower(trim(title)) AS norm FROM papers),
    o AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY arrival) AS n FROM d WHERE norm <> '')"""


@query(with_views(f"WITH {DEDUP} SELECT paper_id, arrival, title FROM o WHERE n = 1", "papers"))
def dedup_titles(spark: SparkSession, folder: str) -> DataFrame:
    return records.first_per_title(tables.papers(spark, folder)).select("paper_id", "arrival", "title")


@query(with_views(f"WITH {DEDUP} SELECT project_id, paper_id, 'paper_' || (row_number() OVER (PARTITION BY project_id ORDER BY arrival) - 1) AS id FROM o WHERE n = 1", "papers"))
def dedup_sequential_ids(spark: SparkSession, folder: str) -> DataFrame:
    kept = records.first_per_title(tables.papers(spark, folder))
    return records.numbered(kept, "project_id").select("project_id", "paper_id", "id")


@query(with_views("""WITH t(term) AS (VALUES ('the'), ('with')),
    hits AS (SELECT term, p.*, row_number() OVER (PARTITION BY term, source ORDER BY arrival) AS n FROM papers p, t WHERE contains(lower(abstract), term)),
    u AS (SELECT DISTINCT ON (lower(trim(title))) * FROM hits WHERE n <= 5 ORDER BY lower(trim(title)), term, arrival)
    SELECT paper_id, term, source FROM u ORDER BY term, arrival LIMIT 30""", "papers"))  # fmt: skip
def federated_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Five hits of each term and source, one per title, thirty in all."""
    return records.federated(tables.papers(spark, folder), ("the", "with"), per_source=5, most=30).select("paper_id", "term", "source")


@query(with_views("""SELECT paper_id, 'title' AS chunk_type, 0::BIGINT AS chunk_index, 'Title: ' || title AS content, (length('Title: ' || title) // 4)::BIGINT AS token_count, 2.0::DOUBLE AS weight FROM papers WHERE title <> ''
    UNION ALL SELECT paper_id, 'abstract', CASE WHEN title <> '' THEN 1 ELSE 0 END, 'Abstract: ' || abstract, length('Abstract: ' || abstract) // 4, 1.8 FROM papers WHERE abstract <> ''""", "papers"))  # fmt: skip
def chunk_title_abstract(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.short_chunks(tables.papers(spark, folder))


@query()
def chunk_full(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunks(tables.papers(spark, folder))


@query(with_views("SELECT md5(concat_ws(':', project_id, paper_id, 'abstract', substr(abstract, 1, 200))) AS chunk_id, substr(sha256(abstract), 1, 32) AS cache_key, paper_id FROM papers", "papers"))
def chunk_hash_ids(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.lit("abstract")
    return tables.papers(spark, folder).select(
        text.chunk_id(F.col("project_id"), F.col("paper_id"), kind, F.col("abstract")).alias("chunk_id"), text.cache_key(F.col("abstract")).alias("cache_key"), "paper_id"
    )


@query(with_views("""WITH v AS (SELECT md5(substr(abstract, 1, 200)) AS id, arrival, source FROM papers)
    SELECT id, max(arrival) AS arrival, arg_max(source, arrival) AS source FROM v GROUP BY id""", "papers"))  # fmt: skip
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    points = tables.papers(spark, folder).select(F.md5(F.substring("abstract", 1, 200)).alias("id"), "arrival", "source")
    old, new = points.where("arrival % 2 = 0"), points.where("arrival % 2 = 1")
    return records.upserted(old, new, "id", "arrival")


@query(with_views("""WITH n AS (SELECT paper_id, md5(abstract) AS k, arrival, row_number() OVER (PARTITION BY md5(abstract) ORDER BY arrival) AS c FROM papers)
    SELECT paper_id, c > 1 AS cached, min(arrival) OVER (PARTITION BY k) AS source_of FROM n""", "papers"))  # fmt: skip
def embedding_memo(spark: SparkSession, folder: str) -> DataFrame:
    """Which abstracts need an embedding and which take that of an earlier equal one."""
    return records.memoized(tables.papers(spark, folder).select("paper_id", "arrival", F.md5("abstract").alias("key")), "key", "arrival").select("paper_id", "cached", "source_of")


@query(with_views("""WITH c AS (SELECT project_id, paper_id, 1 + CAST(abstract <> '' AS INT) AS n FROM papers)
    SELECT project_id, count(*) AS papers, CAST(sum(n) AS BIGINT) AS chunks, round(sum(n) / greatest(count(*), 1), 6) AS chunks_per_paper FROM c GROUP BY project_id""", "papers"))  # fmt: skip
def ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    sized = tables.papers(spark, folder).select("project_id", (1 + F.when(F.col("abstract") != "", 1).otherwise(0)).alias("n"))
    out = sized.groupBy("project_id").agg(F.count(F.lit(1)).alias("papers"), F.sum("n").cast("bigint").alias("chunks"))
    return out.withColumn("chunks_per_paper", F.round(F.col("chunks") / F.greatest("papers", F.lit(1)), 6))
