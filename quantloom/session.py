"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` uses _ for . in names."""
    b = SparkSession.builder.config(map=SETTINGS | {k.replace("_", "."): str(v) for k, v in more.items()})
    return (b.master(master) if master else b).getOrCreate()
