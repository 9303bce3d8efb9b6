"""Session construction with the settings every plan of this package assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tilewright.sources.tiff import SlideSource


def build_session(app: str = "tilewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution that reads ``slide`` files; ``conf`` uses ``__`` for dots (``spark__sql__shuffle__partitions``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.dataSource.register(SlideSource)
    return session
