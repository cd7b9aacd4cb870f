"""Session settings the plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime-settable options.  Joins carry no broadcast hint: Catalyst and AQE compare the measured size of a
# side with autoBroadcastJoinThreshold and fall back to a shuffled join, whose hot partitions AQE splits.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str, master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the options above; `master` and `shuffle_partitions` are for local runs only."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # Call-site capture for every column expression triples the driver round trips of building a plan.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
