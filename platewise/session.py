"""Spark session and scratch-folder helpers for the command line jobs and tests.

Library functions never build a session or change its settings; they take the
caller's DataFrames as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A run may hold a large share of all wells: split its join partitions even
    # where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles a method above 8000 bytes; such a stage is faster in
    # the form that splits its expressions into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording the calling line of every column expression doubles the time to
    # build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach: below ``spark.checkpoint.dir``, or
    below the warehouse where that is not set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/platewise-{uuid.uuid4().hex}"
