"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "ferrowick", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic, adaptive plans and Arrow exchange; ``conf`` is added on top."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def info(spark: SparkSession) -> dict[str, str]:
    """What runs here: version, master and parallelism."""
    return {"version": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism)}
