"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one only where that is unset.

    An unset folder is allowed for a local master alone, as in tests: on a
    cluster a machine-local folder would be invisible to the other machines.
    """
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="tidewheel-")
    spark.conf.set(key, made)
    return made
