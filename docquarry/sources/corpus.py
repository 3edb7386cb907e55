"""Readers for text files and for tables of documents or page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import has_supported_extension
from docquarry.sources.files import read_paged_files
from docquarry.sources.journal import can_open, note_files, stream_files


def document_id(*parts) -> F.Column:
    """A stable document id from whatever names the upload, e.g. upload id and
    file name; unlike a random id it is the same when a task is retried."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def read_corpus(spark: SparkSession, path: str, upload_id: str = "") -> DataFrame:
    """Each file below ``path`` as one row (doc_id, file_name, text, uploaded_at).

    ``.csv`` files are text here, like the others. Files with unsupported
    extensions are kept so that the ingest gate can report them.
    """
    return _uploads(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True), upload_id)


def stream_corpus(spark: SparkSession, path: str, upload_id: str = "", files_each: int | None = None, journal: str | None = None) -> DataFrame:
    """The same as a stream: files that come to lie below ``path`` are taken once each, ``files_each`` in a micro-batch.

    With a ``journal``, a folder kept with the checkpoint, the driver's memory does not grow with the number of files. The
    files that lie there now are noted in it; a stream that goes on takes later ones when ``journal.note_files`` has noted them.
    Where pyarrow does not know the path's scheme, Spark lists the files and no journal is kept.
    """
    if journal and can_open(path):
        note_files(spark, path, journal, files_each)
        files = stream_files(spark, path, journal)
        return files.select(
            document_id(F.lit(upload_id), F.col("file_path")).alias("doc_id"),
            "file_name",
            F.col("value").cast("string").alias("text"),
            F.timestamp_millis("modified_ms").alias("uploaded_at"),
        )
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return _uploads(reader.text(path, wholetext=True), upload_id)


def _uploads(files: DataFrame, upload_id: str) -> DataFrame:
    return files.select(
        document_id(F.lit(upload_id), F.col("_metadata.file_path")).alias("doc_id"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("uploaded_at"),
    )


def supported_files(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    return files.filter(has_supported_extension(F.col(name_col)))


def read_pages(spark: SparkSession, path: str, upload_id: str = "") -> DataFrame:
    """The pages of text files below ``path``, see ``files.read_paged_files``, as (doc_id, file_name, page, text)."""
    pages = read_paged_files(spark, path)
    return pages.select(document_id(F.lit(upload_id), F.col("path")).alias("doc_id"), "file_name", "page", "text")


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
