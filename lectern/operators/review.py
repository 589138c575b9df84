"""A literature review from question to report, as one chain of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import ordered
from lectern.operators.search_index import SearchIndex
from lectern.sources import shared
from lectern.sources.providers import TextProvider

THRESHOLD = 60.0
SINGLE_CHARS, SINGLE_TOKENS = 16_000, 4_000
#: What stands around the entries of a fallback report, in its order.
FALLBACK = (
    "\n\n## Overview\n\nThis literature review covers ",
    ". Due to processing constraints, this is a condensed summary of the research findings.\n\n## Key Papers Analyzed\n\n",
    " additional papers were analyzed but not included in this summary due to length constraints.*\n\n",
    "\n## Conclusion\n\nThis review provides an overview of the current research landscape. For a more detailed analysis, please review the individual paper analyses above.",
)


def relevance(found: DataFrame) -> DataFrame:
    """``relevance_score`` from 0 to 100: a document's score against the best one."""
    best = F.max("score").over(Window.partitionBy("question"))
    return found.withColumn("relevance_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") / best * 100)), 4))


def split_by(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``high_quality`` by the threshold; if no row reaches it all rows count."""
    high = F.col("relevance_score") >= threshold
    none = F.max(high.cast("int")).over(Window.partitionBy("question")) == 0
    return scored.withColumn("high_quality", high | none)


def gate(score: Column, iteration: int, most: int = 2) -> Column:
    """Another round while the score is low and rounds are left."""
    return (F.coalesce(score, F.lit(0.0)) < THRESHOLD) & F.lit(iteration < most)


def fits_one_pass(text: Column) -> Column:
    return (F.length(text) <= SINGLE_CHARS) & (F.floor(F.length(text) / 4) <= SINGLE_TOKENS)


def combined(parts: DataFrame, key: str, order: str, text: str, limit: int, writer: TextProvider) -> DataFrame:
    """Map-reduce summary: the parts of each key are joined in bins of ``limit`` characters and summarised, round by round, until one is left.

    A part over the limit is a bin of its own, so no string grows beyond the longest part or the limit and a line end for each part. Rounds
    that leave as many parts as before and make none shorter would not end; that is an error. A null text counts as empty.
    """
    spark, size, rounds = parts.sparkSession, None, 0
    rows = parts.select(key, F.col(order).cast("long").alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    while True:
        binned = ordered.bins(rows.withColumn("chars", F.length("t")), key, "n", "chars", limit).groupBy(key, "bin")
        joined = binned.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("t"))
        folder = shared.new_folder(spark, "summaries")
        joined.select(key, F.col("bin").alias("n"), writer.summary(F.col("t")).alias("t")).write.parquet(folder)
        rows = spark.read.parquet(folder)
        before, size = size, tuple(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("c")).agg(F.max("n"), F.sum("n"), F.sum("c")).first())
        rounds += 1
        if (size[0] or 0) <= 1:
            return rows.select(key, F.col("t").alias("summary"))
        if size == before:
            raise ValueError(f"summaries got no fewer and no shorter in round {rounds}")


def review(papers: DataFrame, index: SearchIndex, question: str, most: int, writer: TextProvider) -> DataFrame:
    """The ranked papers of a question: score, relevance, whether they enter the report, and their extract."""
    found = index.search(writer.expand(question), most).select(F.col("id").alias("paper_id"), "score", "rank")
    scored = split_by(relevance(found.withColumn("question", F.lit(question))))
    texts = papers.select("paper_id", "title", "abstract")
    out = texts.join(F.broadcast(scored), "paper_id")  # ``most`` rows
    return out.select("question", "rank", "paper_id", "title", "score", "relevance_score", "high_quality", writer.summary(F.col("abstract")).alias("extract"))


def fallback(texts: DataFrame, topic: str, order: str, text: str, most: int = 10) -> DataFrame:
    """``topic, n, synthesis``: a report of each topic out of its first ``most`` texts, for when no other can be made.

    An entry is headed by the first of the text's five first lines that names a title or is a heading, and gives its first three lines that are neither empty
    nor headings, up to 500 characters. Null texts count but are empty. The first rows of a topic are cut off before they are shuffled.
    """
    place = F.row_number().over(Window.partitionBy(topic).orderBy(order))
    first = texts.select(topic, order, F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("place", place).where(F.col("place") <= most)
    lines = F.split("t", "\n")
    names = F.filter(F.slice(lines, 1, 5), lambda x: F.contains(F.lower(x), F.lit("title")) | F.startswith(x, F.lit("#")))
    name = F.trim(F.regexp_replace(F.replace(F.replace(F.get(names, F.lit(0)), F.lit("#"), F.lit("")), F.lit("Title:"), F.lit("")), r"^\s+|\s+$", ""))
    title = F.coalesce(F.substring(name, 1, 100), F.concat(F.lit("Paper "), F.col("place").cast("string")))
    content = F.slice(F.filter(lines, lambda x: x.rlike(r"\S") & ~F.startswith(x, F.lit("#"))), 1, 3)
    entry = F.concat(F.lit("### "), title, F.lit("\n\n"), F.when(F.size(content) > 0, F.concat(F.substring(F.array_join(content, " "), 1, 500), F.lit("...\n\n"))).otherwise(""))
    entries = first.select(topic, "place", entry.alias("entry")).groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("place", "entry"))).alias("e"))
    counts = texts.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(entries.withColumnRenamed(topic, "_topic"), F.col(topic).eqNullSafe(F.col("_topic")))
    more = F.col("n") - most
    note = F.when(more > 0, F.concat(F.lit("\n*Note: "), more.cast("string"), F.lit(FALLBACK[2]))).otherwise("")
    name = F.coalesce(F.col(topic).cast("string"), F.lit(""))
    parts = [F.lit("# Literature Review: "), name, F.lit(FALLBACK[0]), F.col("n").cast("string"), F.lit(" papers on the topic of "), name, F.lit(FALLBACK[1])]
    report = F.concat(*parts, F.array_join(F.transform("e", lambda x: x["entry"]), ""), note, F.lit(FALLBACK[3]))
    return met.select(topic, "n", report.alias("synthesis"))
