"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import work_dir


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there,
    so a lost executor costs no recomputation, and later jobs share the rows."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_columns(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a documents table, whatever else it holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups_for(docs: DataFrame, rows_each: int = 1000) -> int:
    """How many groups of about ``rows_each`` documents the table makes (a count, read from file footers)."""
    return max(8, -(-docs.select("doc_id").count() // rows_each))
