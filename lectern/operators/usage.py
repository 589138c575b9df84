"""Usage and cost roll-ups, quotas and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.routing import TIER_BUDGET, TIER_TOKENS, looked_up


def in_period(calls: DataFrame, start: str, end: str) -> DataFrame:
    """Calls of the days from ``start`` to ``end``, both included."""
    return calls.where(F.to_date("created_at").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def measures() -> list[Column]:
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return [
        F.count(F.lit(1)).alias("calls"),
        total("total_tokens").cast("bigint").alias("tokens"),
        F.round(total("cost_usd"), 6).alias("cost_usd"),
        F.floor(total("latency_ms") / F.count(F.lit(1))).cast("bigint").alias("avg_latency_ms"),
        F.sum(F.when(F.col("success"), 0).otherwise(1)).cast("bigint").alias("errors"),
    ]


def rolled_up(calls: DataFrame, *keys: str | Column) -> DataFrame:
    return calls.groupBy(*keys).agg(*measures())


def all_groupings(calls: DataFrame) -> DataFrame:
    """By agent, by model, by day and in total, in one pass; ``grouping`` tells which. ``calls`` has ``day``."""
    sets = calls.groupingSets([["agent_type"], ["model"], ["day"], []], "agent_type", "model", "day")
    which = F.grouping_id("agent_type", "model", "day")
    name = F.when(which == 3, "agent").when(which == 5, "model").when(which == 6, "day").otherwise("total")
    out = sets.agg(*measures(), name.alias("grouping"))
    return out.select("grouping", "agent_type", "model", "day", "calls", "tokens", "cost_usd", "avg_latency_ms", "errors")


def monthly(calls: DataFrame) -> DataFrame:
    """``user_id, month``: calls, tokens and cost."""
    return calls.groupBy("user_id", F.trunc("created_at", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("total_tokens", F.lit(0))).cast("bigint").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
    )


def budget_limit() -> Column:
    """The user's own budget if it is set and not zero, else the tier's."""
    return F.coalesce(F.nullif("monthly_budget_usd", F.lit(0.0)), looked_up(F.col("tier"), TIER_BUDGET, TIER_BUDGET["free"]))


def token_limit() -> Column:
    return looked_up(F.col("tier"), TIER_TOKENS, TIER_TOKENS["free"]).cast("bigint")


def share(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.round(used / limit * 100, 4)).otherwise(F.lit(0.0))


def summary(users: DataFrame, months: DataFrame, month: str) -> DataFrame:
    """Each user's use in the month against its limits; users without a call have a row of zeros."""
    own = months.where(F.col("month") == F.lit(month).cast("date")).drop("month")
    out = users.join(own, "user_id", "left").select(
        "user_id", "tier", budget_limit().alias("budget_usd"), token_limit().alias("token_limit"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "tokens")), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
    )
    return out.select(
        "*", F.round(F.col("budget_usd") - F.col("cost_usd"), 6).alias("budget_left_usd"), share(F.col("cost_usd"), F.col("budget_usd")).alias("budget_percent"),
        (F.col("token_limit") - F.col("tokens")).alias("tokens_left"), share(F.col("tokens"), F.col("token_limit")).alias("token_percent"),
    )


def budget_check(summaries: DataFrame, estimate: float) -> DataFrame:
    """Refused if the estimate is above zero and would exceed the budget; a warning below a tenth of it."""
    refused = (F.lit(estimate) > 0) & (F.col("cost_usd") + estimate > F.col("budget_usd"))
    low = F.col("budget_left_usd") < F.col("budget_usd") * 0.1
    return summaries.select("user_id", (~refused).alias("allowed"), low.alias("warning"), "budget_left_usd")


def token_check(summaries: DataFrame, estimate: int) -> DataFrame:
    refused = (F.lit(estimate) > 0) & (F.col("tokens") + estimate > F.col("token_limit"))
    return summaries.select("user_id", (~refused).alias("allowed"), "tokens_left")


#: Size of a latency sketch: its ranks are off by well under one in a hundred.
SKETCH_SIZE = 400


def latency_sketches(calls: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, sketch``: a quantile sketch of the latencies of each key, made by map tasks in part. Null latencies don't count."""
    return calls.where("latency_ms IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser keys from stored ones of finer keys; no call is read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def latency_quantiles(sketches: DataFrame, *shares: float) -> DataFrame:
    """A row for each sketch and share: ``share`` and the ``latency_ms`` at it."""
    each = F.array(*(F.struct(F.lit(p).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias("latency_ms")) for p in shares))
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), F.inline(each))
