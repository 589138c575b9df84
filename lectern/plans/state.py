"""State machines and trailing windows over events, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import routing, text
from lectern.operators import machines, ordered
from lectern.plans.registry import query
from lectern.sources import tables
from lectern.sources.tables import with_views

DAY = 86_400
#: The weights of a run's stages; event types stand for stages here.
WEIGHTS = {"click": 10, "view": 20, "purchase": 40, "signup": 20, "error": 10}
ORDERED = "e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return tables.load(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")


@query(f"""WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_id, n, us + 172800000000 AS expires, false AS hit FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.us < r.expires THEN r.expires ELSE e.us + 172800000000 END, e.us < r.expires FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, event_id, hit FROM r""")  # fmt: skip
def ttl_cache_sim(spark: SparkSession, folder: str) -> DataFrame:
    """Accesses to a cache with a key for each user and two days to live."""
    step = lambda s, r: (s.step(r.us, 2 * DAY * 1e6),)
    return machines.run(_events(spark, folder), "user_id", ["us", "event_id"], machines.TtlCache, step, "hit boolean").select("user_id", "event_id", "hit")


@query(f"""WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_type, n, us + 172800000000 AS expires, false AS hit FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_type, e.n, CASE WHEN e.us < r.expires THEN r.expires ELSE e.us + 172800000000 END, e.us < r.expires FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT event_type AS tier, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS misses, round(avg(CAST(hit AS INT)), 6) AS hit_rate FROM r GROUP BY event_type""")  # fmt: skip
def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    step = lambda s, r: (s.step(r.us, 2 * DAY * 1e6),)
    hits = machines.run(_events(spark, folder), "user_id", ["us", "event_id"], machines.TtlCache, step, "hit boolean")
    return hits.groupBy(F.col("event_type").alias("tier")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


REJECTS = "r.opened IS NOT NULL AND e.us - r.opened < 259200000000"


@query(f"""WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_id, n, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, CAST(NULL AS BIGINT) AS opened, 'closed' AS state FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n,
        CASE WHEN {REJECTS} THEN r.failed WHEN e.event_type <> 'error' THEN 0 ELSE r.failed + 1 END,
        CASE WHEN {REJECTS} THEN r.opened WHEN e.event_type <> 'error' THEN NULL WHEN r.failed + 1 >= 2 OR r.opened IS NOT NULL THEN e.us ELSE NULL END,
        CASE WHEN {REJECTS} THEN 'rejected' WHEN e.event_type <> 'error' THEN 'closed' WHEN r.failed + 1 >= 2 OR r.opened IS NOT NULL THEN 'open' ELSE 'closed' END
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, event_id, state FROM r""")  # fmt: skip
def circuit_breaker_sim(spark: SparkSession, folder: str) -> DataFrame:
    """Two errors in a row open a user's breaker for three days."""
    step = lambda s, r: (s.step(r.us, r.event_type != "error", 2, 3 * DAY * 1e6),)
    return machines.run(_events(spark, folder), "user_id", ["us", "event_id"], machines.Breaker, step, "state string").select("user_id", "event_id", "state")


TIER = "CASE event_type WHEN 'purchase' THEN 'powerful' WHEN 'view' THEN 'fast_cheap' ELSE 'balanced' END"
PRICE = "CASE {0} WHEN 'powerful' THEN 0.001::DOUBLE WHEN 'fast_cheap' THEN 0.00001::DOUBLE ELSE 0.0001::DOUBLE END"
TIGHT = f"(r.spent / 0.02 >= 0.8 OR r.spent + e.tokens * 2 / 1000 * {PRICE.format('e.tier')} > 0.02 * 0.9)"


@query(f"""WITH RECURSIVE {ORDERED.replace("event_type, value,", f"{TIER} AS tier, CAST(floor(value * 10) AS BIGINT) AS tokens,")},
    r AS (SELECT user_id, event_id, n, CASE WHEN tokens * 2 / 1000 * {PRICE.format("tier")} > 0.02 * 0.9 THEN 'fast_cheap' ELSE tier END AS tier,
        tokens * 2 / 1000 * CASE WHEN tokens * 2 / 1000 * {PRICE.format("tier")} > 0.02 * 0.9 THEN 0.00001::DOUBLE ELSE {PRICE.format("tier")} END AS spent FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN {TIGHT} THEN 'fast_cheap' ELSE e.tier END, r.spent + e.tokens * 2 / 1000 * CASE WHEN {TIGHT} THEN 0.00001::DOUBLE ELSE {PRICE.format("e.tier")} END
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, event_id, tier, round(spent, 9) AS spent FROM r""")  # fmt: skip
def router_sim(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each user in order against a budget of two cents."""
    tier = F.when(F.col("event_type") == "purchase", "powerful").when(F.col("event_type") == "view", "fast_cheap").otherwise("balanced")
    rows = _events(spark, folder).select("user_id", "event_id", "us", tier.alias("asked"), F.floor(F.col("value") * 10).alias("tokens"))
    step = lambda s, r: s.step(r.asked, r.tokens, 0.02, routing.PRICES)
    return machines.run(rows, "user_id", ["us", "event_id"], machines.Spending, step, "tier string, spent double").select("user_id", "event_id", "tier", "spent")


@query(f"""WITH RECURSIVE {ORDERED.replace("event_type, value,", "least(value, 100.0) AS p, 1 << CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS stage,")},
    r AS (SELECT user_id, event_id, n, stage AS cur, CASE WHEN p >= 100 THEN stage ELSE 0 END AS done, CASE WHEN p >= 100 THEN 0.0 ELSE p END AS pct FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, e.stage, r.done | CASE WHEN r.cur <> e.stage THEN r.cur ELSE 0 END | CASE WHEN e.p >= 100 THEN e.stage ELSE 0 END,
        CASE WHEN e.p < 100 THEN e.p WHEN r.cur <> e.stage THEN 0.0 ELSE r.pct END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1),
    t AS (SELECT *, (done & 1) * 10 + (done & 2) // 2 * 20 + (done & 4) // 4 * 40 + (done & 8) // 8 * 20 + (done & 16) // 16 * 10 AS full_w,
        CASE cur WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 4 THEN 40 WHEN 8 THEN 20 ELSE 10 END AS w FROM r)
    SELECT user_id, event_id, round(least(full_w + CASE WHEN done & cur > 0 THEN 0.0 ELSE pct / 100 * w END, 100.0), 4) AS total FROM t""")  # fmt: skip
def progress_sim(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("percent", F.least("value", F.lit(100.0)))
    step = lambda s, r: (s.step(r.event_type, r.percent, WEIGHTS),)
    return machines.run(rows, "user_id", ["us", "event_id"], machines.Progress, step, "total double").select("user_id", "event_id", "total")


@query(with_views("""WITH RECURSIVE i AS (SELECT source, arrival, length(abstract) AS len, row_number() OVER (PARTITION BY source ORDER BY arrival) AS n FROM papers),
    r AS (SELECT source, arrival, n, 0 AS bin, CASE WHEN len > 1900 THEN NULL ELSE len END AS size, len > 1900 AS cut FROM i WHERE n = 1
    UNION ALL SELECT i.source, i.arrival, i.n, r.bin + CASE WHEN i.len > 1900 OR r.size IS NULL OR r.size + i.len > 1900 THEN 1 ELSE 0 END,
        CASE WHEN i.len > 1900 THEN NULL WHEN r.size IS NULL OR r.size + i.len > 1900 THEN i.len ELSE r.size + i.len END, i.len > 1900 FROM r JOIN i ON i.source = r.source AND i.n = r.n + 1)
    SELECT source, arrival, CAST(bin AS BIGINT) AS bin, cut FROM r""", "papers"))  # fmt: skip
def bin_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracts of each source in order, in bins of 1900 characters; longer ones stand alone, cut."""
    rows = tables.papers(spark, folder).select("source", "arrival", F.length("abstract").alias("len"))
    return ordered.bins(rows, "source", "arrival", "len", 1900).select("source", "arrival", "bin", "cut")


@query(with_views("""SELECT event_id, model, count(*) OVER w - 1 AS calls_before, CAST(sum(total_tokens) OVER w - total_tokens AS BIGINT) AS tokens_before,
    (count(*) OVER w - 1 >= 4 OR sum(total_tokens) OVER w > 300) AS switch FROM calls WINDOW w AS (PARTITION BY model ORDER BY epoch_us(created_at) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""", "calls"))  # fmt: skip
def rate_limit_window(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and tokens of each model in the hour before a call, and whether it should go to another model."""
    rows = tables.calls(spark, folder).select("event_id", "model", F.unix_micros("created_at").alias("us"), "total_tokens")
    near = machines.trailing(rows, "model", "us", "event_id", 3600, "total_tokens")
    switch = (F.col("calls_before") >= 4) | (F.col("amount_before") + F.col("total_tokens") > 300)
    return near.select("event_id", "model", "calls_before", F.col("amount_before").alias("tokens_before"), switch.alias("switch"))


STREAK = """i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS island FROM e),
    s AS (SELECT user_id, event_id, n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY n) AS BIGINT) AS streak FROM i)"""


@query(f"WITH {ORDERED}, {STREAK} SELECT user_id, event_id, streak FROM s")
def failure_streak(spark: SparkSession, folder: str) -> DataFrame:
    return machines.streaks(_events(spark, folder), "user_id", ["us", "event_id"], "event_type = 'error'").select("user_id", "event_id", "streak")


@query(f"WITH {ORDERED}, {STREAK} SELECT user_id, event_id, streak, CASE WHEN streak > 0 THEN least(10 * pow(1.5, streak - 1), 60.0) ELSE 0.0 END AS cooldown_s FROM s")
def cooldown_sim(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds for which a model rests after each failure in a row."""
    rows = machines.streaks(_events(spark, folder), "user_id", ["us", "event_id"], "event_type = 'error'")
    rest = F.when(F.col("streak") > 0, F.least(10 * F.pow(F.lit(1.5), F.col("streak") - 1), F.lit(60.0))).otherwise(0.0)
    return rows.select("user_id", "event_id", "streak", rest.alias("cooldown_s"))


@query(f"""WITH {ORDERED}, {STREAK}, k AS (SELECT user_id, min(n) AS off FROM s WHERE streak >= 3 GROUP BY user_id)
    SELECT e.user_id, count(*) AS calls, CAST(count(*) FILTER (off IS NOT NULL AND n > off) AS BIGINT) AS skipped FROM e LEFT JOIN k USING (user_id) GROUP BY e.user_id""")
def source_killswitch(spark: SparkSession, folder: str) -> DataFrame:
    """Calls that a source loses once it has failed three times in a row."""
    rows = machines.streaks(_events(spark, folder), "user_id", ["us", "event_id"], "event_type = 'error'")
    off = rows.where("streak >= 3").groupBy("user_id").agg(F.min(F.struct("us", "event_id")).alias("off"))
    after = F.col("off").isNotNull() & (F.struct("us", "event_id") > F.col("off"))
    return rows.join(off, "user_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(after).alias("skipped"))


@query(f"""WITH {ORDERED}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY n) > 172800000000 THEN 1 ELSE 0 END AS new FROM e),
    s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS session FROM g)
    SELECT user_id, session, count(*) AS writes, round(sum(value), 6) AS spent FROM s GROUP BY user_id, session""")  # fmt: skip
def spending_counter(spark: SparkSession, folder: str) -> DataFrame:
    """Spending by user that starts anew two days after the last write."""
    rows = machines.sessions(_events(spark, folder), "user_id", "us", "event_id", 2 * DAY)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("writes"), F.round(F.sum("value"), 6).alias("spent"))


@query(with_views("""WITH f AS (SELECT md5(abstract) AS k, min(arrival) AS first_at FROM papers GROUP BY 1), c AS (SELECT * FROM f ORDER BY first_at LIMIT 500)
    SELECT p.paper_id, coalesce(p.arrival > c.first_at, false) AS hit FROM papers p LEFT JOIN c ON c.k = md5(p.abstract)""", "papers"))  # fmt: skip
def bounded_memo(spark: SparkSession, folder: str) -> DataFrame:
    """A memo that takes the first 500 different abstracts and never evicts."""
    rows = tables.papers(spark, folder).select("paper_id", "arrival", F.md5("abstract").alias("k"))
    first = rows.groupBy("k").agg(F.min("arrival").alias("first_at")).orderBy("first_at").limit(500)
    return rows.join(F.broadcast(first), "k", "left").select("paper_id", F.coalesce(F.col("arrival") > F.col("first_at"), F.lit(False)).alias("hit"))


@query(with_views("""WITH m(i, name, ctx) AS (VALUES (1, 'm-large', 600), (2, 'm-mid', 400), (3, 'm-small', 150)),
    o AS (SELECT conv_id, turn, i, name, (conv_id * 7 + turn * 11 + i * 13) % 40 - 20 AS left_s, length(prompt) // 4 <= 0.9 * ctx AS fits FROM prompts, m)
    SELECT conv_id, turn, coalesce(arg_min(name, i) FILTER (left_s <= 0 AND fits), arg_min(name, (greatest(left_s, 0), i))) AS model FROM o GROUP BY conv_id, turn""", "prompts"))  # fmt: skip
def model_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The first model by priority that isn't resting and has room for the prompt, else the one that rests least."""
    tokens = text.n_tokens(F.col("prompt"))
    model = lambda i, name, ctx: F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), ((F.col("conv_id") * 7 + F.col("turn") * 11 + i * 13) % 40 - 20).alias("left_s"), (tokens <= 0.9 * ctx).alias("fits"))
    rows = tables.prompts(spark, folder).withColumn("m", F.array(model(1, "m-large", 600), model(2, "m-mid", 400), model(3, "m-small", 150)))
    ready = F.filter("m", lambda x: (x["left_s"] <= 0) & x["fits"])
    least = F.array_min(F.transform("m", lambda x: F.struct(F.greatest(x["left_s"], F.lit(0)).alias("s"), x["i"].alias("i"), x["name"].alias("name"))))
    return rows.select("conv_id", "turn", F.coalesce(F.get(ready, F.lit(0))["name"], least["name"]).alias("model"))
