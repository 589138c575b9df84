"""JSON objects out of free text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_FENCE = re.compile(r"```(?:json\s*)?|```\s*$")
#: Strings with their escapes, escaped characters and braces: all that decides how deep a place is.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|\\.|[{}]', re.S)


def first_object(answer: str | None) -> str | None:
    """The JSON value that ``answer`` is or, without code fences, the first object in it; missing closing braces are added.

    None where nothing can be read. The result is compact JSON.
    """

    def read(part: str) -> str | None:
        try:
            return json.dumps(json.loads(part), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    clean = _FENCE.sub("", answer or "").strip()
    if not clean or (whole := read(clean)) is not None:
        return read(clean) if clean else None
    start = clean.find("{")
    if start < 0:
        return None
    depth = 0
    for token in _TOKEN.finditer(clean, start):
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if not depth and token[0] == "}":
            return read(clean[start : token.end()])
    return read(clean[start:] + "}" * depth)


def repaired(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``object``, the JSON found in ``column``; what parses as it is never leaves the JVM's parser."""

    @pandas_udf("string")
    def mended(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(first_object)

    plain: Column = F.try_parse_json(F.col(column))
    fine, rest = rows.where(plain.isNotNull()), rows.where(plain.isNull())
    return fine.withColumn("object", F.to_json(plain)).unionByName(rest.withColumn("object", mended(column)))
