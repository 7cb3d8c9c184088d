"""Spark sessions with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI mode makes division by zero and bad casts errors; adaptive execution picks joins and partitions at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "millrace", **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``more`` names settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
