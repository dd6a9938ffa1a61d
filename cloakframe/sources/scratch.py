"""Where jobs put intermediate tables that must outlive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared one that ``spark.checkpoint.dir`` names.

    On a cluster the setting is required. A local master, as in tests, falls back to the folder that its one
    process uses for shuffle files; Spark clears it when the session ends.
    """
    context = spark.sparkContext
    shared = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        shared = context._jvm.org.apache.spark.util.Utils.getLocalDir(context._jsc.sc().conf())
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
