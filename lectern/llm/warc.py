"""WARC archives: records written and read as files of Spark, transactions assembled from their records.

A capture is three records, a request, a response (or revisit) and a metadata record; request and metadata name the
response in WARC-Concurrent-To. Archives are written by the text sink, whose line separator is the empty line pair that
ends a WARC record, and read back whole, record by record, by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

END = "\r\n\r\n"
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload_digest string, page_key string"


def record_id(*parts: object) -> str:
    """The urn of a record, made from what identifies it."""
    digest = hashlib.md5("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=digest)}>"


def _record_ids(kind: str, *columns: str) -> Column:
    """``record_id`` of each row, as a column."""
    text = F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns))
    return F.regexp_replace(F.md5(text.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: str, name: str, uri: str | None, mime: str, block: str, **more: str | None) -> str:
    """A record without the separator that ends it."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if uri:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in more.items() if v]
    lines += [f"Content-Type: {mime}", f"Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}"]
    return "\r\n".join(lines) + END + block


def _transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The three records of each capture as one string."""
    for batch in slices(batches, 256):
        out = []
        for page, url, html, sha, size, ref in zip(*(c.to_pylist() for c in batch.columns)):
            name = record_id("response", page, url, sha, size)
            digest = "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()
            host, target = (re.match(r"(?s).*?://([^/?#]*)(.*)", url or "") or re.match("()()", "")).groups()
            target = re.sub(r"[\x00-\x20]", "+", target.partition("#")[0])
            request = f"GET {target or '/'} HTTP/1.1\r\nHost: {re.sub(r'[\x00-\x20]', '', host)}\r\n\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
            if ref is None:
                main = _record("response", name, url, "application/http; msgtype=response", head + html, Payload_Digest=digest)
            else:
                main = _record("revisit", name, url, "application/http; msgtype=response", head, Payload_Digest=digest, Profile=PROFILE, Refers_To=record_id("response", ref["page"], ref["url"], sha, size))
            meta = f"pageKey: {'' if page is None else page}\r\n"
            out.append(END.join((
                _record("request", record_id("request", name), url, "application/http; msgtype=request", request, Concurrent_To=name),
                main,
                _record("metadata", record_id("metadata", name), url, "application/warc-fields", meta, Concurrent_To=name),
            )))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, per_file: int = 1000) -> None:
    """Write a capture per different page row into ``folder``, gzip-compressed, ``per_file`` captures a file at most.

    Of equal payloads of at least ``min_bytes`` bytes the row with the smallest id (then URL) is a response and the others revisit it.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"))
    keyed = rows.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    keys = scratch.save(keyed.groupBy("page", "url", "sha", "size").count(), "keys")
    order = F.struct(F.col("page").isNull().alias("none"), "page", F.col("url").isNull().alias("bare"), "url")
    first = keys.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min(order).alias("o"))
    first = scratch.save(first.select("sha", "size", F.struct("o.page", "o.url").alias("first")), "first")
    roles = keys.join(first, ["sha", "size"], "left")
    here = F.struct("page", "url")
    ref = F.when(F.col("first").isNotNull() & ~here.eqNullSafe(F.col("first")), F.col("first"))
    roles = scratch.save(roles.select(F.col("page").alias("p"), F.col("url").alias("u"), F.col("sha").alias("s"), F.col("size").alias("z"), ref.alias("ref")), "roles")
    if keys.where("count > 1").isEmpty():
        once = keyed
    else:
        once = keyed.dropDuplicates(["page", "url", "sha", "size"])
    same = once["page"].eqNullSafe(roles["p"]) & once["url"].eqNullSafe(roles["u"]) & (once["sha"] == roles["s"]) & (once["size"] == roles["z"])
    # a revisit has no block to write: its payload stays where it is
    captures = once.join(roles, same).select("page", "url", "html", "sha", "size", "ref")
    captures.mapInArrow(_transactions, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def _members(data: bytes) -> bytes:
    """The content of a gzip file of one or more members, or of a plain file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names lower-cased) and block of each record. What isn't a record's start is skipped to the next."""
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = head.get("content-length", "")
        start = end + 4
        stop = start + (int(size) if size.isdigit() else 0)
        yield head, data[start:stop]
        at = stop + 4 if data[stop + 4 : stop + 9] == b"WARC/" else data.find(b"WARC/", stop)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
    for batch in slices(batches, 1):
        cols: list[list] = [[] for _ in names]
        for head, block in parse(_members(batch.column(0)[0].as_py())):
            kind, size, digest, key = head.get("warc-type"), None, None, None
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
            elif kind == "metadata" and (m := re.search(rb"^pageKey: (.*?)\r?$", block, re.M)):
                key = m[1].decode() or None
            row = (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, size, digest, key)
            for col, x in zip(cols, row):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in ``folder``; digests and lengths of payloads are taken from the bytes read."""
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_parsed, FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, main, requests, metadata``.

    Request and metadata records meet the response or revisit that they are concurrent to; those that name none
    that is there give a capture whose ``main`` is null.
    """
    fields = [c for c in records.columns if c != "concurrent_to"]
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*fields).alias("main"))

    def beside(kind: str, name: str) -> DataFrame:
        own = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return own.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    return main.join(beside("request", "requests"), "capture_id", "full").join(beside("metadata", "metadata"), "capture_id", "full")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, read them back and give each page's capture.

    Returns id, ``payload_bytes``, ``payload_digest`` (bare base32 SHA-1), ``record_type``, ``refers_to`` (an id, for revisits)
    and ``requests`` (request records that came with it). Defined cases: null html is an empty payload, null URLs have no
    target URI; rows that repeat in all of id, URL and html are one capture, returned once for each; an empty table gives an empty result; other
    columns are not read.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    kind = pages.select(id_col).schema[0].dataType
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    folder = scratch.folder("archives")
    write_archives(pages, folder, scratch, min_bytes=min_bytes)
    records = scratch.save(read_archives(spark, folder), "records")
    captures = assemble(records).where("main IS NOT NULL")
    flat = scratch.save(
        captures.select("capture_id", "main.type", "main.refers_to", "main.digest", "main.payload_bytes", "main.payload_digest", F.element_at("metadata.page_key", 1).cast(kind).alias("page"), F.size("requests").cast("long").alias("requests")),
        "captures",
    )
    known = flat.where("type = 'response'").select(F.col("capture_id").alias("at"), F.col("page").alias("ref_page"), F.col("payload_bytes").alias("ref_bytes"))
    # responses meet themselves: with a null key they would all go to one task
    out = flat.withColumn("at", F.coalesce("refers_to", "capture_id")).join(known, "at", "left")
    copies = pages.groupBy("page_id", "url", F.sha1(F.coalesce("html", F.lit(""))).alias("sha")).count().where("count > 1")
    out = out.select(
        F.col("page").alias(id_col), F.coalesce("payload_bytes", "ref_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("ref_page")).alias("refers_to"), "requests", "capture_id",
    )
    if not copies.isEmpty():
        sized = pages.groupBy("page_id", "url", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size")).count().where("count > 1")
        again = sized.select(_record_ids("response", "page_id", "url", "sha", "size").alias("capture_id"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
        out = out.join(again, "capture_id", "left")
    return out.select(id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "requests")
