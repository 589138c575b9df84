"""Scalar functions over prompts, documents, events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import routing, sql, text
from lectern.operators import events, jsonrepair
from lectern.plans.registry import query
from lectern.sources import tables
from lectern.sources.tables import with_views


def _any(column: str, fragments: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{f}')" for f in fragments) + ")"


COMPLEXITY = f"""CASE WHEN length(prompt) > 2000 THEN 'high' WHEN length(prompt) < 200 THEN 'low'
    WHEN {_any("lower(prompt)", routing.COMPLEX)} THEN 'high' WHEN {_any("lower(prompt)", routing.MEDIUM)} THEN 'medium' ELSE 'low' END"""


@query(with_views(f"SELECT conv_id, turn, {COMPLEXITY} AS complexity FROM prompts", "prompts"))
def prompt_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return tables.prompts(spark, folder).select("conv_id", "turn", routing.complexity(F.col("prompt")).alias("complexity"))


@query(with_views("SELECT conv_id, turn, CAST(length(prompt) // 4 AS BIGINT) AS tokens, CAST(greatest(length(prompt) // 4, 10) AS BIGINT) AS routed_tokens, CAST(len(list_filter(string_split_regex(prompt, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM prompts".replace("\\\\", "\\"), "prompts"))
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    prompt = F.col("prompt")
    return tables.prompts(spark, folder).select("conv_id", "turn", text.n_tokens(prompt).alias("tokens"), text.n_tokens(prompt, 10).alias("routed_tokens"), text.n_words(prompt).alias("words"))


ERROR_TEXT = """CASE event_id % 9 WHEN 0 THEN 'HTTP 429: slow down' WHEN 1 THEN 'Timeout while reading' WHEN 2 THEN 'status 503' WHEN 3 THEN 'got 404'
    WHEN 4 THEN 'Quota used up' WHEN 5 THEN 'Network unreachable' WHEN 6 THEN 'validation of field failed' WHEN 7 THEN 'Too Many Requests, Retry after 12.5s' ELSE 'odd ' || event_type END"""
CATEGORY = "CASE " + " ".join(f"WHEN {_any('lower(m)', f)} THEN '{n}'" for n, f in routing.ERRORS) + " ELSE 'unknown' END"


@query(f"""WITH e AS (SELECT event_id, {ERROR_TEXT} AS m, event_id % 6 AS retries FROM events), c AS (SELECT *, {CATEGORY} AS category FROM e)
    SELECT event_id, category, CASE WHEN category = 'client_error' THEN 'low' WHEN category IN ('rate_limit', 'timeout') THEN CASE WHEN retries < 3 THEN 'low' ELSE 'medium' END
        WHEN category = 'quota_exceeded' THEN 'high' WHEN category = 'server_error' THEN CASE WHEN retries < 2 THEN 'low' WHEN retries < 4 THEN 'medium' ELSE 'high' END ELSE 'medium' END AS severity,
    CAST(least(pow(2.0, retries), 60.0) AS DOUBLE) AS wait_s,
    TRY_CAST(coalesce(nullif(regexp_extract(lower(m), 'retry.?after[:\\s]+(\\d+(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(lower(m), '(\\d+(?:\\.\\d+)?)\\s*s(?:econds?)?', 1), '')) AS DOUBLE) AS retry_after_s FROM c""")  # fmt: skip
def error_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.load(spark, folder, "events").select("event_id", F.expr(ERROR_TEXT).alias("m"), (F.col("event_id") % 6).alias("retries"))
    rows = rows.withColumn("category", routing.error_category(F.col("m")))
    severity = routing.error_severity(F.col("category"), F.col("retries"))
    return rows.select("event_id", "category", severity.alias("severity"), routing.backoff(F.col("retries")).alias("wait_s"), text.retry_after(F.col("m")).alias("retry_after_s"))


@query(with_views("""WITH t AS (SELECT conv_id, turn, greatest(length(prompt) // 4, 10) AS tokens, CASE role WHEN 'system' THEN 'powerful' WHEN 'user' THEN 'fast_cheap' ELSE 'balanced' END AS tier FROM prompts)
    SELECT conv_id, turn, tier, round(tokens * 2 / 1000 * CASE tier WHEN 'powerful' THEN 0.001::DOUBLE WHEN 'fast_cheap' THEN 0.00001::DOUBLE ELSE 0.0001::DOUBLE END, 9) AS cost_usd,
    CAST(CASE tier WHEN 'powerful' THEN 1500 WHEN 'fast_cheap' THEN 200 ELSE 500 END + tokens // 100 * 50 AS BIGINT) AS latency_ms FROM t""", "prompts"))  # fmt: skip
def cost_estimate(spark: SparkSession, folder: str) -> DataFrame:
    tier = F.when(F.col("role") == "system", "powerful").when(F.col("role") == "user", "fast_cheap").otherwise("balanced")
    rows = tables.prompts(spark, folder).select("conv_id", "turn", text.n_tokens(F.col("prompt"), 10).alias("tokens"), tier.alias("tier"))
    return rows.select("conv_id", "turn", "tier", F.round(routing.cost(F.col("tier"), F.col("tokens")), 9).alias("cost_usd"), routing.latency(F.col("tier"), F.col("tokens")).alias("latency_ms"))


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(with_views(rf"""WITH w AS (SELECT paper_id, list_filter(string_split_regex(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '\s+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ({STOP})) AS l FROM papers)
    SELECT paper_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 10), ' ') AS keywords FROM w""", "papers"))  # fmt: skip
def keyword_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return tables.papers(spark, folder).select("paper_id", F.array_join(text.keywords(F.col("title")), " ").alias("keywords"))


@query("""WITH d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 7 AS VARCHAR) || 'm' || CAST(value AS VARCHAR) || 's' WHEN 1 THEN CAST(value AS VARCHAR) || 's' WHEN 2 THEN '2m' WHEN 3 THEN 'soon' ELSE 'x3m1s' END AS d,
    event_id % 7 * 60 + value AS a, value FROM events)
    SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN a WHEN 1 THEN value WHEN 2 THEN 120.0 WHEN 3 THEN 60.0 ELSE 60.0 END, 6) AS seconds FROM d""")  # fmt: skip
def parse_duration(spark: SparkSession, folder: str) -> DataFrame:
    n, value = F.col("event_id"), F.col("value").cast("string")
    told = (
        F.when(n % 5 == 0, F.concat((n % 7).cast("string"), F.lit("m"), value, F.lit("s"))).when(n % 5 == 1, F.concat(value, F.lit("s")))
        .when(n % 5 == 2, "2m").when(n % 5 == 3, "soon").otherwise("x3m1s")
    )
    return tables.load(spark, folder, "events").select("event_id", F.round(text.seconds(told), 6).alias("seconds"))


@query("""WITH d AS (SELECT doc_id, text, CAST(floor(floor(length(text) * 0.5) / 2) AS BIGINT) AS h FROM documents)
    SELECT doc_id, md5(CASE WHEN length(text) <= 3000 THEN text ELSE substr(text, 1, h) || chr(10) || chr(10) || '[... Content truncated to fit token limits ...]' || chr(10) || chr(10) || right(text, h) END) AS short_md5 FROM d""")  # fmt: skip
def prompt_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return tables.load(spark, folder, "documents").select("doc_id", F.md5(text.shortened(F.col("text"), longest=3000)).alias("short_md5"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    return tables.load(spark, folder, "events").select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""WITH a AS (SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || props || ' - done'
        WHEN 2 THEN '{"a": ' || props ELSE 'no object here' END AS answer FROM events)
    SELECT event_id, answer, CAST(json(CASE event_id % 4 WHEN 2 THEN '{"a":' || props || '}' WHEN 3 THEN NULL ELSE props END) AS VARCHAR) AS object FROM a""")
def json_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Objects wrapped in fences, prose or cut off, by turns."""
    n, props = F.col("event_id"), F.col("props")
    answer = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("Here it is: "), props, F.lit(" - done")))
    answer = answer.when(n % 4 == 2, F.concat(F.lit('{"a": '), props)).otherwise(F.lit("no object here"))
    return jsonrepair.repaired(tables.load(spark, folder, "events").select("event_id", answer.alias("answer")), "answer")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages
    WHERE trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) <> '' AND url <> ''""")
def html_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of pages, cleaned; pages without one are no records."""
    title = text.clean(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return tables.load(spark, folder, "pages").select("page_id", "url", title.alias("title")).where("title <> '' AND url <> ''").select("page_id", "title")


@query("""SELECT event_id, split_part('project:' || user_id || ':updates', ':', 2) AS project_id, event_type AS type,
    CASE event_type WHEN 'error' THEN 'An error occurred' ELSE event_type || ' is now running' END AS message, CASE event_type WHEN 'purchase' THEN 100.0 ELSE least(value, 100.0) END AS progress FROM events""")
def channel_parse(spark: SparkSession, folder: str) -> DataFrame:
    messages = tables.load(spark, folder, "events").withColumn("channel", F.concat(F.lit("project:"), F.col("user_id").cast("string"), F.lit(":updates")))
    return events.typed(messages)


@query("""WITH subs AS (SELECT c_custkey AS subscriber, c_custkey % 50 AS project FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT s.subscriber, count(*) AS delivered FROM events e JOIN subs s ON s.project = e.user_id AND s.subscriber <> e.event_id % 100 GROUP BY s.subscriber""")
def subscription_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that each subscriber of a project gets, its own left out."""
    subs = tables.load(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subscriber"), (F.col("c_custkey") % 50).alias("project"))
    sent = tables.load(spark, folder, "events").select(F.col("user_id").alias("project"), (F.col("event_id") % 100).alias("sender"))
    return events.fanned_out(sent, subs).groupBy("subscriber").agg(F.count(F.lit(1)).alias("delivered"))


@query("""WITH a AS (SELECT user_id, event_id % 40 AS socket, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL)
    SELECT user_id AS project, count(*) AS subscribers FROM a WHERE last = 'signup' GROUP BY user_id""")
def subscription_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Sockets whose last action was to subscribe, by project; sign-ups stand for subscribing, errors for leaving."""
    acts = tables.load(spark, folder, "events").where(F.col("event_type").isin("signup", "error"))
    acts = acts.select(F.col("user_id").alias("project"), (F.col("event_id") % 40).alias("socket"), (F.col("event_type") == "signup").alias("joins"), "ts", "event_id")
    return events.subscribers(acts)


@query("""SELECT event_id, '{"event_id":' || event_id || ',"type":"' || event_type || '"' || CASE WHEN value > 50 THEN ',"slow":true' ELSE '' END || '}' AS line FROM events""")
def trace_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines without their empty fields."""
    slow = F.when(F.col("value") > 50, F.lit(True))
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("type"), slow.alias("slow")), {"ignoreNullFields": "true"})
    return tables.load(spark, folder, "events").select("event_id", line.alias("line"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) = text AS is_clean, CAST(len(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS BIGINT) AS words,
    CAST(length(text) // 4 AS BIGINT) AS tokens, md5(concat_ws(':', source, CAST(doc_id AS VARCHAR), 'text', substr(text, 1, 200))) AS chunk, substr(sha256(text), 1, 16) AS cached, least(pow(2.0, doc_id % 9), 60.0) AS wait_s FROM documents""")
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """A query in SQL that calls the library's functions."""
    sql.register(spark)
    return spark.sql(
        """SELECT doc_id, clean_text(text) = text AS is_clean, CAST(size(text_tokens(text)) AS BIGINT) AS words, token_count(text) AS tokens,
        chunk_key(source, CAST(doc_id AS STRING), 'text', text) AS chunk, cache_key(text, 16) AS cached, backoff_s(doc_id % 9) AS wait_s FROM {docs}""",
        docs=tables.load(spark, folder, "documents"),
    )
