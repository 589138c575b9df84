"""The library's text functions as SQL functions, for queries written in SQL.

They are SQL-bodied: Spark inlines the bodies, so nothing leaves the JVM and the optimizer sees through them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = {
    "clean_text(t STRING) RETURNS STRING": r"trim(regexp_replace(coalesce(t, ''), '\\s+', ' '))",
    "text_tokens(t STRING) RETURNS ARRAY<STRING>": r"filter(split(regexp_replace(lower(t), '[^\\p{L}\\p{N}_\\s]', ' '), '\\s+'), w -> w <> '')",
    "token_count(t STRING) RETURNS BIGINT": "length(t) div 4",
    "chunk_key(project STRING, paper STRING, kind STRING, body STRING) RETURNS STRING": "md5(concat_ws(':', project, paper, kind, substring(body, 1, 200)))",
    "cache_key(t STRING, n INT) RETURNS STRING": "substring(sha2(t, 256), 1, n)",
    "rrf(place BIGINT) RETURNS DOUBLE": "1 / (60 + place)",
    "backoff_s(retries BIGINT) RETURNS DOUBLE": "least(pow(2.0D, retries), 60.0D)",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


class Tools:
    """Named functions from tables to a table, called by name; an unknown name is an error."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[..., DataFrame], str]] = {}

    def register(self, name: str, function: Callable[..., DataFrame], description: str = "") -> None:
        self._known[name] = (function, description)

    def invoke(self, name: str, *args: Any, **options: Any) -> DataFrame:
        if name not in self._known:
            raise ValueError(f"no tool named {name!r}; there are {sorted(self._known)}")
        return self._known[name][0](*args, **options)

    def described(self) -> dict[str, str]:
        return {name: about for name, (_, about) in self._known.items()}
