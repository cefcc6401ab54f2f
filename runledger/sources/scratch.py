"""Where tables that live no longer than the application are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the cluster's spark.checkpoint.dir; only where that is unset and Spark runs on one machine (tests) a
    folder of this session is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = getattr(spark, "_runledger_scratch", None)
        if base is None:
            base = spark._runledger_scratch = "file://" + tempfile.mkdtemp(prefix="runledger-")
    return f"{base.rstrip('/')}/runledger/{spark.sparkContext.applicationId}"
