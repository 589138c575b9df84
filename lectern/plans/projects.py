"""Projects, papers, reports and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import projects
from lectern.plans.registry import query
from lectern.sources import tables
from lectern.sources.tables import with_views


@query(with_views("""WITH c AS (SELECT project_id, string_agg(line || ':' || paper, ',' ORDER BY line, paper) AS papers, count(*) AS n FROM refs GROUP BY project_id)
    SELECT p.project_id, p.user_id, u.name, p.status, coalesce(c.papers, '') AS papers, coalesce(n, 0) AS n_papers
    FROM projects p LEFT JOIN c USING (project_id) LEFT JOIN users u ON u.user_id = p.user_id""", "projects", "refs", "users"))  # fmt: skip
def project_tree(spark: SparkSession, folder: str) -> DataFrame:
    out = projects.tree(tables.projects(spark, folder), tables.references(spark, folder), tables.users(spark, folder))
    lines = F.array_join(F.transform("papers", lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["paper"].cast("string"))), ",")
    return out.select("project_id", "user_id", "name", "status", F.coalesce(lines, F.lit("")).alias("papers"), F.coalesce(F.size("papers"), F.lit(0)).cast("bigint").alias("n_papers"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS at_us FROM events GROUP BY user_id")
def project_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return projects.latest(events, "user_id", "event_type", "ts", "event_id").select("user_id", "event_type", F.unix_micros("ts").alias("at_us"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 12")
def project_ring_buffer(spark: SparkSession, folder: str) -> DataFrame:
    return projects.last_n(tables.load(spark, folder, "events"), "user_id", "ts", "event_id", 12).select("user_id", "event_id", "place")


@query(with_views("SELECT r.project_id, count(*) AS n FROM refs r WHERE project_id NOT IN (SELECT project_id FROM projects WHERE status = 'P') GROUP BY r.project_id", "projects", "refs"))
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the papers when the projects of one status are deleted."""
    gone = tables.projects(spark, folder).where("status = 'P'").select("project_id")
    return projects.without(tables.references(spark, folder), gone, "project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT project_id, line, paper FROM refs WHERE project_id IN (SELECT project_id FROM projects WHERE user_id IN (1, 7, 11))", "projects", "refs"))
def tenant_semi(spark: SparkSession, folder: str) -> DataFrame:
    own = tables.projects(spark, folder).where(F.col("user_id").isin(1, 7, 11))
    return tables.references(spark, folder).join(own, "project_id", "left_semi").select("project_id", "line", "paper")


@query(with_views("SELECT project_id, status FROM projects WHERE user_id = 7 AND status IN ('O', 'P') ORDER BY created_on DESC, project_id LIMIT 50", "projects"))
def tenant_projects(spark: SparkSession, folder: str) -> DataFrame:
    own = tables.projects(spark, folder).where((F.col("user_id") == 7) & F.col("status").isin("O", "P"))
    return own.orderBy(F.desc("created_on"), "project_id").limit(50).select("project_id", "status")


@query(with_views("SELECT project_id, line, relevance_score FROM refs WHERE (relevance_score >= 100.5 OR NOT EXISTS (SELECT 1 FROM refs WHERE relevance_score >= 100.5))", "refs"))
def fallback_set(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.references(spark, folder).select("project_id", "line", "relevance_score")
    return projects.or_all(rows, "relevance_score >= 100.5")


@query(with_views("""WITH c AS (SELECT project_id, methodology, count(*) AS n FROM refs GROUP BY ALL),
    h AS (SELECT project_id, string_agg(methodology || '=' || n, ',' ORDER BY methodology || '=' || n) AS methodology_histogram, arg_max(methodology, (n, methodology)) AS main FROM c GROUP BY project_id)
    SELECT r.project_id, count(*) AS found, count(DISTINCT paper) AS after_dedup, CAST(count(*) FILTER (relevance_score >= 70) AS BIGINT) AS high,
    round(coalesce(avg(coalesce(relevance_score, 0)), 0), 6) AS avg_relevance, any_value(methodology_histogram) AS methodology_histogram, any_value(main) AS main_methodology
    FROM refs r JOIN h USING (project_id) GROUP BY r.project_id""", "refs"))  # fmt: skip
def report_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.references(spark, folder)
    stats = rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("found"), F.count_distinct("paper").alias("after_dedup"), F.count_if(F.col("relevance_score") >= 70).alias("high"),
        F.round(F.coalesce(F.avg(F.coalesce("relevance_score", F.lit(0.0))), F.lit(0.0)), 6).alias("avg_relevance"),
    )
    counts = rows.groupBy("project_id", "methodology").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("project_id").agg(F.max_by("methodology", F.struct("n", "methodology")).alias("main_methodology"))
    return stats.join(projects.histogram(rows, "project_id", "methodology"), "project_id").join(main, "project_id")


@query(with_views("""SELECT year, methodology, count(*) AS papers, round(avg(relevance_score), 6) AS strength, list_aggregate(list_slice(list(DISTINCT paper ORDER BY paper), 1, 5), 'string_agg', ',') AS paper_ids
    FROM refs GROUP BY year, methodology""", "refs"))  # fmt: skip
def theme_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Year and methodology stand for a theme; the five smallest paper ids are listed."""
    rows = tables.references(spark, folder)
    stats = rows.groupBy("year", "methodology").agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg("relevance_score"), 6).alias("strength"))
    place = F.row_number().over(Window.partitionBy("year", "methodology").orderBy("paper"))
    few = rows.select("year", "methodology", "paper").distinct().withColumn("place", place).where("place <= 5")
    few = few.groupBy("year", "methodology").agg(F.array_join(F.transform(F.array_sort(F.collect_list("paper")), lambda p: p.cast("string")), ",").alias("paper_ids"))
    return stats.join(few, ["year", "methodology"])


@query("""SELECT d.doc_id, CAST(CASE WHEN quality = 1 THEN 90.0 ELSE 40.0 END AS DOUBLE) AS score, quality = 1 AS high_quality,
    CASE WHEN quality = 1 THEN '' ELSE 'below threshold' END AS skipped FROM documents d JOIN labels l USING (doc_id) WHERE text <> '' AND quality IS NOT NULL""")  # fmt: skip
def relevance_split(spark: SparkSession, folder: str) -> DataFrame:
    """Documents at or above the threshold of 60, and the others with the reason why they are skipped."""
    scored = tables.load(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, 90.0).otherwise(40.0).alias("score"))
    docs = tables.load(spark, folder, "documents").where("text <> ''").select("doc_id")
    high = F.col("score") >= 60.0
    return docs.join(scored, "doc_id").select("doc_id", "score", high.alias("high_quality"), F.when(high, "").otherwise("below threshold").alias("skipped"))


@query(with_views("SELECT project_id, line, paper, coalesce(relevance_score, 0) AS score, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(relevance_score, 0) DESC, line, paper) AS place FROM refs", "refs"))
def sort_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """The papers of each project, best first."""
    rows = tables.references(spark, folder).select("project_id", "line", "paper", F.coalesce("relevance_score", F.lit(0.0)).alias("score"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "line", "paper"))
    return rows.withColumn("place", place.cast("bigint"))


@query(with_views("""WITH t AS (SELECT project_id, count(*) AS total, CAST(count(*) FILTER (relevance_score >= 50) AS BIGINT) AS done FROM refs GROUP BY project_id)
    SELECT p.project_id, status, CASE status WHEN 'P' THEN 5.0 WHEN 'F' THEN 100.0 ELSE round(20 + 70 * CASE WHEN coalesce(total, 0) > 0 THEN coalesce(done, 0) / total ELSE 0.0 END, 4) END AS percent
    FROM projects p LEFT JOIN t USING (project_id)""", "projects", "refs"))  # fmt: skip
def project_progress(spark: SparkSession, folder: str) -> DataFrame:
    counts = tables.references(spark, folder).groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("relevance_score") >= 50).alias("done"))
    out = tables.projects(spark, folder).join(counts, "project_id", "left").fillna(0, ["total", "done"])
    return out.select("project_id", "status", projects.progress("status", "done", "total").alias("percent"))


@query(with_views("""WITH m AS (SELECT user_id, min(project_id) AS first_project FROM projects GROUP BY user_id), w AS (SELECT user_id + CASE WHEN user_id % 5 = 0 THEN 1000000 ELSE 0 END AS user_id, first_project FROM m)
    SELECT w.user_id, coalesce(u.tier, 'free') AS tier, coalesce(u.monthly_budget_usd, 1.0) AS budget_usd, u.user_id IS NULL AS created FROM w LEFT JOIN users u ON u.user_id = w.user_id""", "projects", "users"))  # fmt: skip
def get_or_create_user(spark: SparkSession, folder: str) -> DataFrame:
    """Users who sign in, every fifth unknown as yet: those get the free tier and a budget of one."""
    wanted = tables.projects(spark, folder).select((F.col("user_id") + F.when(F.col("user_id") % 5 == 0, 1_000_000).otherwise(0)).alias("user_id")).distinct()
    known = tables.users(spark, folder).withColumn("there", F.lit(True))
    out = wanted.join(known, "user_id", "left")
    return out.select("user_id", F.coalesce("tier", F.lit("free")).alias("tier"), F.coalesce("monthly_budget_usd", F.lit(1.0)).alias("budget_usd"), F.col("there").isNull().alias("created"))


@query(with_views("""WITH s AS (SELECT project_id, count(*) AS n FROM refs GROUP BY project_id)
    SELECT project_id, k AS section, CAST(3000 // 4 AS BIGINT) AS words, n AS analyses FROM s, (VALUES (1), (2), (3), (4)) t(k)""", "refs"))  # fmt: skip
def section_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Four sections of equal length a project, each over all of its analyses."""
    counts = tables.references(spark, folder).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("project_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("section"), F.lit(3000 // 4).cast("bigint").alias("words"), F.col("n").alias("analyses"))
