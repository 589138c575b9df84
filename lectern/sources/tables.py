"""Tables of a dataset folder and the domain views over them.

The views are conventions of this library: they read generic tables as papers, calls, users and projects.
``VIEWS`` states the same views in SQL, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as papers: the first line is the title and the whole text the abstract; the document number is the order of arrival."""
    return load(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("paper_id"),
        F.col("doc_id").alias("arrival"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.col("text").alias("full_text"),
        "source",
        F.col("source").alias("project_id"),
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as logged model calls."""
    return load(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("agent_type"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens"),
        (F.col("value") / 1000).alias("cost_usd"),
        F.floor(F.col("value") * 10).alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """``customer`` as users with a tier and, for some, no budget of their own."""
    segment = F.col("c_mktsegment")
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.when(segment == "HOUSEHOLD", "pro").when(segment == "MACHINERY", "enterprise").otherwise("free").alias("tier"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("monthly_budget_usd"),
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"),
        F.to_date("o_orderdate").alias("created_on"),
    )


def references(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as the papers of projects, with a relevance of 0 to 100."""
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").alias("paper"),
        F.least(F.lit(100.0), F.col("l_quantity") * 2).alias("relevance_score"), F.col("l_returnflag").alias("methodology"),
        F.year("l_shipdate").cast("bigint").alias("year"), F.col("l_suppkey").alias("source"),
    )


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))


VIEWS = {
    "papers": """SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id AS arrival, split_part(text, chr(10), 1) AS title,
        text AS abstract, text AS full_text, source, source AS project_id FROM documents""",
    "calls": """SELECT event_id, user_id, ts AS created_at, event_type AS agent_type, 'm' || CAST(event_id % 3 AS VARCHAR) AS model,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens, value / 1000 AS cost_usd,
        CAST(floor(value * 10) AS BIGINT) AS latency_ms, event_type <> 'error' AS success FROM events""",
    "users": """SELECT c_custkey AS user_id, c_name AS name,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'pro' WHEN 'MACHINERY' THEN 'enterprise' ELSE 'free' END AS tier,
        CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000 END AS monthly_budget_usd FROM customer""",
    "projects": """SELECT o_orderkey AS project_id, o_custkey AS user_id, o_orderstatus AS status,
        CAST(o_orderdate AS DATE) AS created_on FROM orders""",
    "refs": """SELECT l_orderkey AS project_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS paper,
        least(100.0, l_quantity * 2) AS relevance_score, l_returnflag AS methodology,
        CAST(year(l_shipdate) AS BIGINT) AS year, l_suppkey AS source FROM lineitem""",
    "prompts": "SELECT conv_id, turn, role, text AS prompt FROM conversations",
}


def with_views(sql: str, *names: str) -> str:
    """``sql``, a SELECT or a WITH, after the named views."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    head, _, rest = sql.strip().partition(" ")
    if head.upper() == "WITH":
        recursive = rest.strip().upper().startswith("RECURSIVE ")
        rest = rest.strip()[len("RECURSIVE ") :] if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}{views}, {rest}"
    return f"WITH {views} {sql}"
