"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("verisift")
    if master:
        builder = builder.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}.items() | conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
