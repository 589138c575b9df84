"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so: a chunk is at least ``min_chars`` characters, then runs to the next
sentence mark or line end, ``max_chars`` at most. Equal texts therefore have equal chunks. Chunks are
deduplicated once to verified identifiers; a document is then the ordered list of its chunk identifiers (its recipe),
and only recipes, eight bytes for each chunk, are compared. Long texts are never moved again for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

SALTS = 64


def chunk_list(text: Column, min_chars: int = 512, max_chars: int = 4096) -> Column:
    """The content-defined chunks of ``text``, in order; together they are the text. Empty text: no chunk."""
    rest = max_chars - min_chars - 1
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{min_chars}}}[^.!?\n]{{0,{rest}}}+.?|.+"), F.lit(0))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 512, max_chars: int = 4096, scratch: Scratch | None = None
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``text_hash``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of a group the row with the
    largest id stays. ``text_hash`` is the XXH64 of the text as it was, which tells rows of one id apart. ``scratch`` gets the tables
    between the steps. Defined cases: null ids sort below all others, and a group of null ids only keeps them all under a null ``keep_id``; rows that repeat an id count singly, and all rows with the largest id stay; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    lowered = docs.select(F.col(id_col).alias("id"), text.alias("body"), F.xxhash64(text_col).alias("was"))
    cut = lowered.select("id", "was", chunk_list(F.col("body"), min_chars, max_chars).alias("chunks"), F.sha2("body", 256).alias("sha"))

    # every different chunk once; map tasks drop their own repeats before the shuffle
    chunks = cut.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk").distinct()
    # an identifier is verified when one chunk only has it; other chunks are told apart by their SHA-256 as well
    shared = scratch.save(chunks.groupBy("h").count().where("count > 1").select("h"), "collided")

    recipes = scratch.save(
        cut.select("id", "was", "sha", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe")), "recipes"
    )
    if not shared.isEmpty():
        recipes = scratch.save(_verified(recipes, cut, shared), "verified")

    salted = recipes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = salted.groupBy("recipe", "salt").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    parts = scratch.save(parts, "parts")
    whole = parts.groupBy("recipe").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    whole = parts.select("recipe", "salt").join(whole, "recipe")
    out = salted.join(whole, ["recipe", "salt"])
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), F.col("was").alias("text_hash"))


def _verified(recipes: DataFrame, cut: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes in which a chunk with a collided identifier also carries 120 bits of its SHA-256.

    Runs only where two different chunks share a 64-bit identifier. Such recipes get longer entries, equal for equal
    texts and different for different ones.
    """
    named = cut.select("id", "sha", F.posexplode("chunks").alias("pos", "chunk"))
    named = named.select("id", "sha", "pos", F.xxhash64("chunk").alias("h"), F.sha2("chunk", 256).alias("full"))
    hit = named.join(shared, "h", "left_semi").select("sha").distinct()
    redone = named.join(hit, "sha", "left_semi").groupBy("sha", "id", "pos").agg(F.first("h").alias("h"), F.first("full").alias("full"))
    half = lambda at: F.conv(F.substring("full", at, 15), 16, 10).cast("bigint")
    redone = redone.groupBy("sha", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "h", half(1).alias("a"), half(16).alias("b")))).alias("r"))
    redone = redone.select("sha", "id", F.flatten(F.transform("r", lambda x: F.array(x.h, x.a, x.b))).alias("longer"))
    # rows that repeat both id and text keep one entry each
    both = recipes.join(redone, (recipes.sha == redone.sha) & recipes.id.eqNullSafe(redone.id), "left")
    return both.select(recipes.id, recipes.was, recipes.sha, F.coalesce("longer", "recipe").alias("recipe"))
