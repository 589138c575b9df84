"""Records out of what search services answer: Atom feeds and JSON pages, one answer a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text

ATOM = "entry array<struct<title: string, summary: string, id: string, author: array<struct<name: string>>>>"
PAGE = "data array<struct<title: string, abstract: string, url: string, authors: array<struct<name: string>>>>"


def _names(people: Column) -> Column:
    names = F.transform(F.coalesce(people, F.array().cast("array<struct<name: string>>")), lambda a: a["name"])
    return F.filter(names, lambda n: n.isNotNull())


def atom(answers: DataFrame, column: str, source: str, *keys: str) -> DataFrame:
    """``keys, title, abstract, authors, url, source`` of each entry that has title, summary and id; broken XML gives none."""
    entries = answers.select(*keys, F.inline(F.from_xml(column, ATOM)["entry"]))
    whole = entries.where("title IS NOT NULL AND summary IS NOT NULL AND id IS NOT NULL")
    return whole.select(*keys, text.clean(F.col("title")).alias("title"), text.clean(F.col("summary")).alias("abstract"), _names(F.col("author")).alias("authors"), F.col("id").alias("url"), F.lit(source).alias("source"))


def page(answers: DataFrame, column: str, source: str, *keys: str) -> DataFrame:
    """The same of each item of a JSON page with a title, an abstract and an address, none of them empty."""
    items = answers.select(*keys, F.inline(F.from_json(column, PAGE)["data"]))
    whole = items.where("title <> '' AND abstract <> '' AND url <> ''")
    return whole.select(*keys, text.clean(F.col("title")).alias("title"), text.clean(F.col("abstract")).alias("abstract"), _names(F.col("authors")).alias("authors"), "url", F.lit(source).alias("source"))
