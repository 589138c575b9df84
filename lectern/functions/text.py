"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword extraction leaves out.
STOPWORDS = (
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "is", "are", "was", "were", "how", "what", "why", "when",
    "does", "do", "can", "could", "would", "should",
)
#: Weights of section types in retrieval.
SECTION_WEIGHTS = {
    "title": 2.0, "abstract": 1.8, "conclusion": 1.5, "results": 1.3, "methodology": 1.2, "introduction": 1.1, "discussion": 1.1,
    "general": 1.0, "references": 0.5,
}


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores of any script."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda t: t != "")


def n_tokens(text: Column, least: int = 0) -> Column:
    """A quarter of the characters, rounded down."""
    quarter = F.floor(F.length(text) / 4).cast("bigint")
    return F.greatest(quarter, F.lit(least).cast("bigint")) if least else quarter


def n_words(text: Column) -> Column:
    stripped = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, " "))).cast("bigint")


def chunk_id(project: Column, paper: Column, kind: Column, content: Column) -> Column:
    return F.md5(F.concat_ws(":", project, paper, kind, F.substring(content, 1, 200)))


def cache_key(text: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def title_entry(title: Column, authors: Column) -> Column:
    """The title with at most five authors."""
    names = F.concat(F.array_join(F.slice(authors, 1, 5), ", "), F.when(F.size(authors) > 5, " et al.").otherwise(""))
    return F.concat(F.lit("Title: "), title, F.when(F.size(authors) > 0, F.concat(F.lit(" by "), names)).otherwise(""))


def section_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in SECTION_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def keywords(text: Column, most: int = 10) -> Column:
    """The first ``most`` different words of three or more plain letters that aren't stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def seconds(duration: Column) -> Column:
    """Seconds of ``2m59.56s``; without minutes and seconds zero, and 60 if a number can't be read."""
    parts = F.split(duration, "m")
    has_minutes = F.size(parts) > 1
    rest = F.when(has_minutes, F.get(parts, F.lit(1))).otherwise(duration)
    minutes = F.when(has_minutes, F.get(parts, F.lit(0)).try_cast("double") * 60).otherwise(F.lit(0.0))
    left = F.when(rest.contains("s"), F.replace(rest, F.lit("s"), F.lit("")).try_cast("double")).otherwise(F.lit(0.0))
    return F.coalesce(minutes + left, F.lit(60.0))


def retry_after(message: Column) -> Column:
    """Seconds named after "retry after", else before "s"; null without either."""
    low = F.lower(message)
    named = F.regexp_extract(low, r"retry.?after[:\s]+(\d+(?:\.\d+)?)", 1)
    bare = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*s(?:econds?)?", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit(""))).cast("double")


def shortened(prompt: Column, share: float = 0.5, longest: int = 20_000, marker: str = "\n\n[... Content truncated to fit token limits ...]\n\n") -> Column:
    """Texts over ``longest`` characters keep head and tail, half each of ``share`` of their length."""
    half = F.floor(F.floor(F.length(prompt) * share) / 2).cast("int")
    cut = F.concat(F.substring(prompt, F.lit(1), half), F.lit(marker), F.right(prompt, half))
    return F.when(F.length(prompt) <= longest, prompt).otherwise(cut)


def as_list(record: Column, key: str) -> Column:
    """Field ``key`` of a JSON object as a list of strings: lists stay, other values are lists of one, empty ones and none are empty."""
    parsed = F.try_parse_json(record)
    kind = F.coalesce(F.schema_of_variant(F.variant_get(parsed, f"$.{key}", "variant")), F.lit("VOID"))
    one = F.try_variant_get(parsed, f"$.{key}", "string")
    falsy = (one == "") | ((kind == "BIGINT") & (one == "0")) | ((kind == "BOOLEAN") & (one == "false")) | (kind == "OBJECT<>")
    many = F.try_variant_get(parsed, f"$.{key}", "array<string>")
    return F.when(kind.startswith("ARRAY"), many).when(one.isNull() | falsy, F.array().cast("array<string>")).otherwise(F.array(one))


def clamped(score: Column, default: int = 50) -> Column:
    """A score from 0 to 100; null takes the default."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(score.cast("int"), F.lit(default))))
