"""Session settings shared by jobs, benchmarks and tests."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "docledger", cores: str | None = None, **extra: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster spark-submit supplies the master."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if cores:
        defaults["spark.sql.shuffle.partitions"] = cores
    for key, value in {**defaults, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "docledger-checkpoints"))
