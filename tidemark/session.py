"""Session construction with the settings the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session: UTC clock, ANSI arithmetic, adaptive execution.

    ``master`` and ``shuffle_partitions`` are left to the cluster when not given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()
