"""The corpus pipeline: language ID, exact dedup, near-dedup, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All stages but the last return the
columns of ``docs``; ``run`` writes each result as Parquet and rereads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, language_id, near_copies, packing, suffix_dedup
from lectern.llm.common import Scratch
from lectern.llm.queries import PACKING_TOKENIZER, tokenizer_path


#: Bytes of a passage that the pipeline holds for repeated. Passages of over fifty words have 244 bytes and more in 99 of 100 cases.
PASSAGE_BYTES = 240


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter, long texts that resemble no language. Null languages are filled in."""
    return language_id.keep_known(docs, language_id.fit(docs))


def _without(docs: DataFrame, judged: DataFrame, steps: Scratch) -> DataFrame:
    """``docs`` but for the rows that ``judged`` doesn't keep: the same id, null or not, and the same text. ``steps`` are over then."""
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = Scratch(docs.sparkSession, "stage").save(gone, "gone")
    steps.only()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased) the one with the largest id stays."""
    steps = Scratch(spark, "stage-exact")
    return _without(docs, exact_dedup.exact_dedup(docs, scratch=steps), steps)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by pairs of five-word Jaccard similarity 0.8 or more the one with the smallest id stays."""
    steps = Scratch(spark, "stage-near")
    return _without(docs, near_copies.near_copies(docs, scratch=steps), steps)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_BYTES bytes and more that start elsewhere too are cut out of the texts; ``n_chars`` follows."""
    out = suffix_dedup.remove_passages(docs, length=PASSAGE_BYTES)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens at most."""
    return packing.pack_documents(docs, tokenizer_path(PACKING_TOKENIZER))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_passages),
    ("best_fit_packing", packed),
]

#: SQL has no byte-pair tokenizer and no fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
