"""A data source of search services' answers: ``spark.read.format("search_answers")`` and ``readStream``.

A page of a term's answer is a partition, fetched by an executor and passed on as it came; ``lectern.sources.feeds`` makes records of it.
What can't be fetched is a row with an ``error``, so that one bad page doesn't fail the others. As a stream, pages are the offsets: a query that starts
again from its checkpoint fetches only pages after the last one it committed.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "term string, page int, answer string, error string"
AGENT = "lectern/1 (document retrieval)"
#: Answers that may be asked for again: too many requests, and faults of the server.
AGAIN = (429, 500, 502, 503, 504)


@dataclass
class Page(InputPartition):
    term: str
    number: int


@dataclass
class Options:
    """``url`` is an address with ``{term}``, ``{page}``, ``{start}`` and ``{size}`` in it; of saved answers it is that of a page's folder, ending with a slash,
    in a store that Arrow reads. ``terms`` is a JSON list; ``pages`` are fetched of each, from 0, with ``size`` records a page."""

    url: str
    terms: list[str]
    pages: int
    size: int
    tries: int
    wait: float
    timeout: float

    @classmethod
    def of(cls, options: dict) -> Options:
        terms = json.loads(options["terms"])
        if "url" not in options or not all(isinstance(t, str) for t in terms):
            raise ValueError("search_answers needs a url and a JSON list of terms")
        numbers = {k: kind(options.get(k, default)) for k, kind, default in (("pages", int, 1), ("size", int, 10), ("tries", int, 3), ("wait", float, 3), ("timeout", float, 30))}
        return cls(options["url"], list(dict.fromkeys(terms)), **numbers)

    def address(self, page: Page) -> str:
        return self.url.format(term=urllib.parse.quote(page.term, safe=""), page=page.number, start=page.number * self.size, size=self.size)


def fetched(options: Options, page: Page) -> Iterator[tuple]:
    """One row: the answer or what went wrong; none for a page that isn't there."""
    address, error = options.address(page), ""
    if address.endswith("/") and not address.startswith("http"):
        yield from _saved(address, page)
        return
    for attempt in range(options.tries):
        if attempt:
            time.sleep(attempt * options.wait)
        try:
            request = urllib.request.Request(address, headers={"User-Agent": AGENT})
            with urllib.request.urlopen(request, timeout=options.timeout) as answer:
                yield page.term, page.number, answer.read().decode("utf-8"), None
                return
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return
            error = f"HTTP {e.code}"
            if e.code not in AGAIN:
                break
        except UnicodeDecodeError:
            error = "not UTF-8"
            break
        except OSError as e:  # no connection, or a time-out
            error = str(getattr(e, "reason", e))
    yield page.term, page.number, None, error


def _saved(folder: str, page: Page) -> Iterator[tuple]:
    """A page saved as a folder of parts, in any store that Arrow reads."""
    try:
        store, path = FileSystem.from_uri(folder.rstrip("/"))
        if store.get_file_info(path).type == FileType.Directory:
            parts = sorted(f.path for f in store.get_file_info(FileSelector(path)) if f.base_name.startswith("part-"))
            yield page.term, page.number, b"".join(store.open_input_stream(p).read() for p in parts).decode("utf-8"), None
    except (OSError, ValueError) as e:
        yield page.term, page.number, None, str(e)


class Answers(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Page]:
        return [Page(t, n) for t in self.options.terms for n in range(self.options.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return fetched(self.options, partition)


class AnswerStream(DataSourceStreamReader):
    """Offsets are numbers of pages that are fetched of every term."""

    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"pages": self.options.pages}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(t, n) for t in self.options.terms for n in range(start["pages"], end["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return fetched(self.options, partition)


class SearchAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return Answers(Options.of(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return AnswerStream(Options.of(self.options))


def options(url: str, terms: list[str], pages: int = 1, size: int = 10, **more: object) -> dict[str, str]:
    """Options for ``spark.read.format("search_answers").options(**...)``."""
    return {"url": url, "terms": json.dumps(list(terms)), "pages": str(pages), "size": str(size)} | {k: str(v) for k, v in more.items()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchAnswers)
