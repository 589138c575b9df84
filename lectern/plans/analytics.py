"""Usage analytics over logged model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import usage
from lectern.plans.registry import query
from lectern.sources import shared, tables
from lectern.sources.tables import with_views

START, END, MONTH = "2024-01-02", "2024-01-20", "2024-01-01"
PERIOD = f"CAST(created_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"
MEASURES = """count(*) AS calls, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens, round(sum(coalesce(cost_usd, 0)), 6) AS cost_usd,
    CAST(floor(sum(coalesce(latency_ms, 0)) / count(*)) AS BIGINT) AS avg_latency_ms, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS errors"""


def _period(spark: SparkSession, folder: str) -> DataFrame:
    return usage.in_period(tables.calls(spark, folder), START, END)


@query(with_views(f"SELECT agent_type, {MEASURES} FROM calls WHERE {PERIOD} GROUP BY agent_type", "calls"))
def usage_by_agent(spark: SparkSession, folder: str) -> DataFrame:
    return usage.rolled_up(_period(spark, folder), "agent_type")


@query(with_views(f"SELECT model, {MEASURES} FROM calls WHERE {PERIOD} GROUP BY model", "calls"))
def usage_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return usage.rolled_up(_period(spark, folder), "model")


@query(with_views(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, {MEASURES} FROM calls WHERE {PERIOD} GROUP BY day", "calls"))
def usage_daily(spark: SparkSession, folder: str) -> DataFrame:
    return usage.rolled_up(_period(spark, folder), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(with_views(f"SELECT {MEASURES} FROM calls WHERE {PERIOD}", "calls"))
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    return usage.rolled_up(_period(spark, folder))


@query(with_views(f"""WITH d AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM calls WHERE {PERIOD})
    SELECT CASE WHEN grouping(agent_type) = 0 THEN 'agent' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(day) = 0 THEN 'day' ELSE 'total' END AS "grouping",
    agent_type, model, day, {MEASURES} FROM d GROUP BY GROUPING SETS ((agent_type), (model), (day), ())""", "calls"))  # fmt: skip
def usage_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return usage.all_groupings(_period(spark, folder).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")))


MONTHLY = """monthly AS (SELECT user_id, CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS calls,
    CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens, round(sum(cost_usd), 6) AS cost_usd FROM calls GROUP BY ALL)"""
SUMMARY = f"""{MONTHLY}, s AS (SELECT users.user_id, tier,
    coalesce(nullif(monthly_budget_usd, 0), CASE tier WHEN 'pro' THEN 10.0 WHEN 'enterprise' THEN 100.0 ELSE 1.0 END)::DOUBLE AS budget_usd,
    CAST(CASE tier WHEN 'pro' THEN 1000000 WHEN 'enterprise' THEN 10000000 ELSE 100000 END AS BIGINT) AS token_limit,
    coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, coalesce(cost_usd, 0.0) AS cost_usd
    FROM users LEFT JOIN (SELECT * FROM monthly WHERE month = DATE '{MONTH}') m ON m.user_id = users.user_id),
    summary AS (SELECT *, round(budget_usd - cost_usd, 6) AS budget_left_usd, CASE WHEN budget_usd > 0 THEN round(cost_usd / budget_usd * 100, 4) ELSE 0.0 END AS budget_percent,
    token_limit - tokens AS tokens_left, CASE WHEN token_limit > 0 THEN round(tokens / token_limit * 100, 4) ELSE 0.0 END AS token_percent FROM s)"""


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return usage.summary(tables.users(spark, folder), usage.monthly(tables.calls(spark, folder)), MONTH)


@query(with_views(f"WITH {MONTHLY} SELECT * REPLACE (strftime(month, '%Y-%m-%d') AS month) FROM monthly", "calls"))
def usage_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return usage.monthly(tables.calls(spark, folder)).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query(with_views(f"WITH {SUMMARY} SELECT * FROM summary", "calls", "users"))
def usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder)


@query(with_views(f"WITH {SUMMARY} SELECT user_id, NOT (cost_usd + 0.5 > budget_usd) AS allowed, budget_left_usd < budget_usd * 0.1 AS warning, budget_left_usd FROM summary", "calls", "users"))
def budget_check(spark: SparkSession, folder: str) -> DataFrame:
    return usage.budget_check(_summary(spark, folder), 0.5)


@query(with_views(f"WITH {SUMMARY} SELECT user_id, NOT (tokens + 99500 > token_limit) AS allowed, tokens_left FROM summary", "calls", "users"))
def token_check(spark: SparkSession, folder: str) -> DataFrame:
    return usage.token_check(_summary(spark, folder), 99_500)


@query(with_views("""WITH s AS (SELECT agent_type, list(latency_ms ORDER BY latency_ms) AS l FROM calls GROUP BY agent_type)
    SELECT agent_type, round(list_avg(l), 6) AS mean, l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS p95 FROM s""", "calls"))  # fmt: skip
def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, and the value at 0.95 of the sorted latencies: found by counting equal values, so that no list is gathered."""
    calls = tables.calls(spark, folder)
    values = calls.groupBy("agent_type", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("agent_type").orderBy("latency_ms"))
    total = F.sum("n").over(Window.partitionBy("agent_type"))
    ranked = values.select("agent_type", "latency_ms", "n", upto.alias("upto"), F.floor(total * 0.95).alias("at"))
    return ranked.groupBy("agent_type").agg(
        F.round(F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.min(F.when(F.col("upto") > F.col("at"), F.col("latency_ms"))).alias("p95")
    )


SHARES, RANK_ERROR = (0.5, 0.9, 0.95, 0.99), 0.02


@query(with_views(f"""SELECT strftime(created_at, '%Y-%m') AS month, agent_type, share, count(*) AS n, true AS within
    FROM calls, (SELECT unnest([{", ".join(map(str, SHARES))}]::DOUBLE[]) AS share) WHERE latency_ms IS NOT NULL GROUP BY ALL""", "calls"))  # fmt: skip
def latency_percentiles_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of months merged from stored sketches of days, and whether their exact ranks lie within the sketches' error."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    calls = tables.calls(spark, folder).withColumn("day", day).withColumn("month", F.substring("day", 1, 7))
    daily = shared.new_folder(spark, "latency-by-day")
    usage.latency_sketches(calls, "month", "day", "agent_type").write.partitionBy("month").parquet(daily)
    stored = spark.read.parquet(daily).withColumn("month", F.col("month").cast("string"))
    found = usage.latency_quantiles(usage.merged_sketches(stored, "month", "agent_type"), *SHARES)
    # rows of months, agents and shares meet the calls' counts by value
    values = calls.where("latency_ms IS NOT NULL").groupBy("month", "agent_type", F.col("latency_ms").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranks = found.join(values, ["month", "agent_type"]).groupBy("month", "agent_type", "share", "n", "latency_ms")
    ranks = ranks.agg(F.sum(F.when(F.col("v") < F.col("latency_ms"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("latency_ms"), F.col("c")).otherwise(0)).alias("upto"))
    within = (F.col("below") / F.col("n") - RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("upto") / F.col("n") + RANK_ERROR)
    return ranks.select("month", "agent_type", "share", "n", within.alias("within"))
