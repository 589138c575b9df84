"""Cost, latency and routing decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price of a thousand tokens, in USD, and base latency, in milliseconds.
PRICES = {"fast_cheap": 0.00001, "balanced": 0.0001, "powerful": 0.001}
LATENCY = {"fast_cheap": 200, "balanced": 500, "powerful": 1500}
#: The tier each kind of task takes.
TASKS = {
    "extract_keywords": "fast_cheap", "classify_relevance": "fast_cheap", "simple_parsing": "fast_cheap", "format_output": "fast_cheap",
    "paper_analysis": "balanced", "summarization": "balanced", "search_planning": "balanced", "relevance_scoring": "balanced",
    "synthesis": "powerful", "quality_evaluation": "powerful", "research_gap_identification": "powerful", "complex_reasoning": "powerful",
}
#: What makes a prompt of middling length complex, or medium.
COMPLEX = ("synthesize", "compare", "contrast", "evaluate", "research gap", "critical analysis", "methodology")
MEDIUM = ("analyze", "summarize", "explain", "describe")
#: Error categories and the fragments that tell them, first match wins.
ERRORS = (
    ("rate_limit", ("429", "rate limit", "too many requests")),
    ("timeout", ("timeout",)),
    ("server_error", ("500", "502", "503", "504")),
    ("client_error", ("400", "401", "403", "404")),
    ("quota_exceeded", ("quota", "limit exceeded")),
    ("network", ("network", "connection")),
    ("validation", ("validation",)),
)
#: Limits by user tier.
TIER_BUDGET = {"free": 1.0, "pro": 10.0, "enterprise": 100.0}
TIER_TOKENS = {"free": 100_000, "pro": 1_000_000, "enterprise": 10_000_000}


def looked_up(key: Column, table: dict, default: object) -> Column:
    """The table's value for the key, else the default. Tables are a handful of entries: one branch each."""
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def has_any(text: Column, fragments: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for fragment in fragments:
        out = out | text.contains(fragment)
    return out


def cost(tier: Column, tokens: Column) -> Column:
    """Price of a call whose answer is as long as its prompt."""
    return tokens * 2 / 1000 * looked_up(tier, PRICES, PRICES["balanced"])


def latency(tier: Column, tokens: Column) -> Column:
    return (looked_up(tier, LATENCY, LATENCY["balanced"]) + F.floor(tokens / 100) * 50).cast("bigint")


def complexity(prompt: Column) -> Column:
    low = F.lower(prompt)
    return (
        F.when(F.length(prompt) > 2000, "high")
        .when(F.length(prompt) < 200, "low")
        .when(has_any(low, COMPLEX), "high")
        .when(has_any(low, MEDIUM), "medium")
        .otherwise("low")
    )


def error_category(message: Column) -> Column:
    low, out = F.lower(message), F.lit("unknown")
    for name, fragments in reversed(ERRORS):
        out = F.when(has_any(low, fragments), name).otherwise(out)
    return out


def error_severity(category: Column, retries: Column) -> Column:
    return (
        F.when(category == "client_error", "low")
        .when(category.isin("rate_limit", "timeout"), F.when(retries < 3, "low").otherwise("medium"))
        .when(category == "quota_exceeded", "high")
        .when(category == "server_error", F.when(retries < 2, "low").when(retries < 4, "medium").otherwise("high"))
        .otherwise("medium")
    )


def backoff(retries: Column, first: float = 1.0, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before a retry, without jitter."""
    return F.least(first * F.pow(F.lit(base), retries), F.lit(most))


def choice(task: Column, tokens: Column, spent: Column, budget: Column, text_complexity: Column, hint: Column | None = None, max_latency: Column | None = None) -> Column:
    """The tier for one call: task rule, budget downgrade, upgrades by complexity, latency downgrade."""
    rule = looked_up(task, TASKS, "balanced")
    ratio = F.when(budget > 0, spent / budget).otherwise(F.lit(0.0))
    tight = (ratio >= 0.8) | (spent + cost(rule, tokens) > budget * 0.9)
    tier = F.when(tight, "fast_cheap").otherwise(rule)
    if hint is not None:
        tier = F.when(~tight & F.coalesce(hint == "high", F.lit(False)) & (spent + cost(F.lit("powerful"), tokens) < budget), "powerful").otherwise(tier)
    if max_latency is not None:
        slow = F.coalesce(latency(tier, tokens) > max_latency, F.lit(False))
        tier = F.when(slow & (tier == "powerful"), "balanced").when(slow & (tier == "balanced"), "fast_cheap").otherwise(tier)
    lifts = ~tight & (text_complexity == "high") & (tier == "fast_cheap") & (spent + cost(F.lit("balanced"), tokens) < budget)
    lifts = lifts if hint is None else lifts & hint.isNull()
    return F.when(lifts, "balanced").otherwise(tier)


def provider_choice(task: Column, spent: Column, budget: Column, hint: Column, max_latency: Column) -> Column:
    """The tier a single provider takes: task rule, cheapest from 80 % of the budget on, hints, one step down if slow.

    Unlike ``choice`` a low hint always takes the cheapest tier, and the base latency alone is held against the limit.
    """
    tight = F.coalesce(F.when(budget > 0, spent / budget) >= 0.8, F.lit(False))
    tier = F.when(tight, "fast_cheap").otherwise(looked_up(task, TASKS, "balanced"))
    tier = F.when(F.coalesce(hint == "high", F.lit(False)) & ~tight, "powerful").when(F.coalesce(hint == "low", F.lit(False)), "fast_cheap").otherwise(tier)
    slow = F.coalesce((max_latency > 0) & (looked_up(tier, LATENCY, LATENCY["balanced"]) > max_latency), F.lit(False))
    return F.when(slow & (tier == "powerful"), "balanced").when(slow & (tier == "balanced"), "fast_cheap").otherwise(tier)
