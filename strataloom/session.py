"""Session defaults for local runs and tests; a cluster's own session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "strataloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; options given by name override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
