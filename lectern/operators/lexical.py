"""BM25 over documents as joins and sums."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text

K1, B = 1.5, 0.75


def term_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, df, idf``: number of documents with the term, and its weight. Only partial counts are shuffled; rows are documents."""
    words = docs.select(F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("term"))
    found = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = docs.agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(size)).select("term", "df", _idf().alias("idf"))


def _idf():
    return F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def bm25(docs: DataFrame, query: str, id_col: str = "paper_id", text_col: str = "full_text", *keys: str) -> DataFrame:
    """``keys, id, score`` of the documents with a query word; a word that the query repeats counts as often.

    ``keys`` make separate indexes: corpus sizes, document frequencies and mean lengths are per key.
    Only words of the query are exploded and shuffled, whatever the length of the documents.
    """
    terms = Counter(query_words(query))
    if not terms:
        return docs.select(*keys, F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    read = docs.select(*keys, F.col(id_col).alias("id"), text.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    read = read.select(*keys, "id", F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(*terms)).alias("words"))
    corpus = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avgdl"))
    hits = read.select(*keys, "id", "dl", F.explode("words").alias("term")).groupBy(*keys, "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = hits.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    # one row for each key, and for each key and query word
    scored = hits.join(frequency, [*keys, "term"])
    scored = scored.join(corpus, list(keys)) if keys else scored.crossJoin(F.broadcast(corpus))
    times = F.create_map(*(F.lit(x) for pair in terms.items() for x in pair))[F.col("term")]
    tf = F.col("tf")
    part = times * _idf() * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy(*keys, "id").agg(F.round(F.sum(part), 6).alias("score"))


def query_words(query: str) -> list[str]:
    """The words of a question, as ``text.tokens`` cuts texts."""
    return "".join(c if c.isalnum() or c in "_ \t\n" else " " for c in query.lower()).split()


def top(scored: DataFrame, k: int, *keys: str, score: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` best rows, of each key if any, with their ``rank``."""
    order = [F.desc(score), F.asc(tie)]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")) if keys else None
    if ranked is not None:
        return ranked.where(F.col("rank") <= k)
    best = scored.orderBy(*order).limit(k)
    # at most k rows are left
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
