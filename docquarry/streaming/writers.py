"""Names for the writers of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The writer id that belongs to a checkpoint folder.

    It is the name of a file in that folder: a restart finds it again, and
    a checkpoint that was reset gets a new one along with its new batch numbers.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/writer")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        names = sorted(status.getPath().getName() for status in files.listStatus(folder))
        if names:
            return names[0]
    name = f"w{uuid.uuid4().hex}"
    files.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/writer/{name}"))
    return name
