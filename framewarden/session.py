"""Session settings for local runs and tests.

On a cluster the session comes from the platform; nothing in the package
depends on the settings below except the UTC time zone.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "framewarden", cpus: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Test tables are small: let a shuffle of 1 MB still use all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "96k")
        .config("spark.driver.memory", os.environ.get("FRAMEWARDEN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and round trips: the one the cluster names.

    A local session without the setting uses one in its warehouse.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()
