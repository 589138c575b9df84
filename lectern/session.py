"""Session defaults shared by tests, the bench and applications."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", app: str = "lectern", **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, AQE on, Arrow on.

    Extra settings are passed with ``_`` for ``.`` in their names or in a dict expansion.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
