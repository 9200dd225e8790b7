"""Session settings and the shared folder that written tables go to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.enableVectorizedReader": "true",
    # call sites are looked up for every column, and plans here have hundreds
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "stagewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    ``master`` is left to spark-submit unless given, so the same code runs on a
    cluster and on ``local[n]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Days, ISO weeks and as-of moments are all defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def workspace(spark: SparkSession) -> str:
    """The shared folder for written tables, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with the machine, so that is refused.
    """
    context = spark.sparkContext
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or context.getConf().get("spark.checkpoint.dir")
            or context.getCheckpointDir())
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="stagewise-")
        context.setCheckpointDir(base)
    return base.rstrip("/") + "/stagewise"
