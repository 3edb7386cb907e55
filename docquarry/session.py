"""Session helpers: settings the operators rely on, and partition sizing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "docquarry", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that arrives in fewer splits than there are cores.

    A large table already has more splits than cores and passes unchanged, so
    this never shuffles the data it is meant for; it only stops a small file
    from running a Python stage on one core. Meant for a table just read: on a
    plan with shuffles, counting its partitions would run them.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= parallelism:
        return df
    return df.repartition(parallelism)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder all nodes share.

    Only a local session may go without the setting, and gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = tempfile.mkdtemp(prefix="docquarry-")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")
