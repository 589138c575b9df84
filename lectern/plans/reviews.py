"""Whole reviews, summaries, quality gates, schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import projects, review
from lectern.plans.registry import query
from lectern.plans.retrieval import BM25, QUESTION, paper_index
from lectern.sources import providers, tables
from lectern.sources.tables import with_views


@query(with_views(f"""WITH {BM25.replace('full_text', 'abstract')}, t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25 ORDER BY score DESC, id LIMIT 30),
    r AS (SELECT *, round(greatest(0.0, least(100.0, score / max(score) OVER () * 100)), 4) AS relevance_score FROM t)
    SELECT '{QUESTION}' AS question, rank, id AS paper_id, title, score, relevance_score, relevance_score >= 60 OR max(CAST(relevance_score >= 60 AS INT)) OVER () = 0 AS high_quality,
    CASE WHEN regexp_extract(substr(abstract, 1, 200), '(?s)^.*[.!?]') <> '' THEN regexp_extract(substr(abstract, 1, 200), '(?s)^.*[.!?]') ELSE substr(abstract, 1, 200) END AS extract
    FROM r JOIN papers ON papers.paper_id = r.id""", "papers"))  # fmt: skip
def literature_review(spark: SparkSession, folder: str) -> DataFrame:
    return review.review(tables.papers(spark, folder), paper_index(spark, folder), QUESTION, 30, providers.Extracts())


@query()
def map_reduce_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracts of each source, summarised in bins until one summary is left."""
    return review.combined(tables.papers(spark, folder), "source", "arrival", "abstract", 13_200, providers.Extracts())


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 90.0::DOUBLE ELSE 30.0::DOUBLE END AS score, coalesce(quality, 0) = 0 AS refine FROM labels""")
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    scored = tables.load(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, 90.0).otherwise(30.0).alias("score"))
    return scored.select("doc_id", "score", review.gate(F.col("score"), iteration=0).alias("refine"))


@query("SELECT doc_id, length(text) <= 16000 AND length(text) // 4 <= 4000 AS one_pass FROM documents")
def size_gate(spark: SparkSession, folder: str) -> DataFrame:
    return tables.load(spark, folder, "documents").select("doc_id", review.fits_one_pass(F.col("text")).alias("one_pass"))


@query("SELECT unnest(['monthly_budget_usd', 'report', 'tier']) AS missing")
def schema_check(spark: SparkSession, folder: str) -> DataFrame:
    """Required columns that a table of users hasn't got yet."""
    have = tables.load(spark, folder, "customer").columns
    return spark.range(1).select(F.explode(F.array_except(F.array(*map(F.lit, ("c_custkey", "c_name", "tier", "monthly_budget_usd", "report"))), F.array(*map(F.lit, have)))).alias("missing"))


@query("SELECT c_custkey, coalesce(NULL, 'free') AS tier, 1.0::DOUBLE AS monthly_budget_usd FROM customer")
def schema_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """Users with the columns that they lack, at their defaults."""
    users = tables.load(spark, folder, "customer")
    added = {"tier": F.lit("free"), "monthly_budget_usd": F.lit(1.0)}
    return users.withColumns({k: v for k, v in added.items() if k not in users.columns}).select("c_custkey", *added)


@query(with_views("""WITH m AS (SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS calls FROM calls GROUP BY ALL)
    SELECT u.user_id, coalesce(calls, 0) AS calls FROM users u LEFT JOIN (SELECT * FROM m WHERE month = '2024-02') m USING (user_id)""", "calls", "users"))  # fmt: skip
def month_row(spark: SparkSession, folder: str) -> DataFrame:
    """A row of zeros for users without a call in the month."""
    month = tables.calls(spark, folder).where(F.date_format("created_at", "yyyy-MM") == "2024-02").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"))
    return tables.users(spark, folder).join(month, "user_id", "left").select("user_id", F.coalesce("calls", F.lit(0)).alias("calls"))


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def session_kv(spark: SparkSession, folder: str) -> DataFrame:
    """The session last saved by each user."""
    rows = tables.load(spark, folder, "events")
    return projects.last_n(rows, "user_id", "ts", "event_id", 1).select("user_id", "event_type", "event_id")


@query("""SELECT source, string_agg(entry, ' | ' ORDER BY doc_id) AS fallback FROM (SELECT source, doc_id, substr(text, 1, 50) AS entry, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 10 GROUP BY source""")
def fallback_report(spark: SparkSession, folder: str) -> DataFrame:
    """A report of a source's first ten documents, for when no text can be made."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = tables.load(spark, folder, "documents").select("source", "doc_id", F.substring("text", 1, 50).alias("entry")).withColumn("n", place).where("n <= 10")
    return rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda x: x["entry"]), " | ").alias("fallback"))


@query()
def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Offline embeddings of all abstracts."""
    return tables.papers(spark, folder).select("paper_id", providers.HashEmbeddings().embed(F.col("abstract")).alias("embedding"))


@query(f"""WITH d AS (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
    t AS (SELECT source, place, list_filter(l[1:5], lambda x: contains(lower(x), 'title') OR starts_with(x, '#'))[1] AS name,
        list_filter(l, lambda x: regexp_matches(x, '\\S') AND NOT starts_with(x, '#'))[1:3] AS c FROM d WHERE place <= 10),
    e AS (SELECT source, string_agg('### ' || coalesce(substr(regexp_replace(replace(replace(name, '#', ''), 'Title:', ''), '^\\s+|\\s+$', '', 'g'), 1, 100), 'Paper ' || place) || chr(10) || chr(10)
        || CASE WHEN len(c) > 0 THEN substr(array_to_string(c, ' '), 1, 500) || '...' || chr(10) || chr(10) ELSE '' END, '' ORDER BY place) AS e FROM t GROUP BY source),
    n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT source, n, '# Literature Review: ' || source || '{review.FALLBACK[0]}' || n || ' papers on the topic of ' || source || '{review.FALLBACK[1]}' || e
        || CASE WHEN n > 10 THEN chr(10) || '*Note: ' || (n - 10) || '{review.FALLBACK[2]}' ELSE '' END || '{review.FALLBACK[3]}' AS synthesis
    FROM n JOIN e USING (source)""")  # fmt: skip
def fallback_synthesis(spark: SparkSession, folder: str) -> DataFrame:
    """A report of each source's first ten documents in the form that stands in for a written one."""
    return review.fallback(tables.load(spark, folder, "documents"), "source", "doc_id", "text")
