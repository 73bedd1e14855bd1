"""Session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and sizes shuffles; Arrow carries the few Python operators.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "spindle", **conf: str) -> SparkSession:
    """A session with the defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, on one machine a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        place = tempfile.mkdtemp(prefix="spindle-")
    return f"{place.rstrip('/')}/spindle-{what}-{uuid.uuid4().hex}"
