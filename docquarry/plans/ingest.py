"""Documents to stored, embedded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators.chunking import chunk_pages, chunk_text
from docquarry.operators.embedding import ModelFactory, embed
from docquarry.sources.store import files_for, spread_documents


def accepted(docs: DataFrame) -> DataFrame:
    """Uploads that pass the gates before chunking (named, supported, not blank)."""
    return docs.filter(
        F.col("file_name").isNotNull()
        & tx.has_supported_extension(F.col("file_name"))
        & ~tx.is_blank(F.col("text"))
    )


def embedded_documents(
    docs: DataFrame,
    model: ModelFactory | None = None,
    chunk_size: int = tx.CHUNK_SIZE,
    overlap: int = tx.CHUNK_OVERLAP,
    buckets: int | None = None,
    files_per_bucket: int | None = None,
) -> DataFrame:
    """Gate, chunk and embed ``docs(doc_id, file_name, text, uploaded_at)``.

    Rejected files leave before any Python runs. With ``buckets`` the texts are
    first gathered for a tidy write to the store, in as many files as their size asks for unless ``files_per_bucket`` is given.
    """
    docs = accepted(docs)
    if buckets:
        docs = spread_documents(docs, buckets, files_per_bucket)
    return embed(chunk_text(docs, chunk_size=chunk_size, overlap=overlap), model=model)


def embedded_pages(
    pages: DataFrame,
    names: DataFrame,
    model: ModelFactory | None = None,
    buckets: int | None = None,
    files_per_bucket: int | None = None,
    **options,
) -> DataFrame:
    """The same for paged documents: ``pages(doc_id, page, text)`` and
    ``names(doc_id, file_name, uploaded_at)``.

    Documents without a supported name leave first; those with blank pages alone give no chunks.
    """
    named = names.filter(F.col("file_name").isNotNull() & tx.has_supported_extension(F.col("file_name")))
    pages = pages.join(named.select("doc_id"), "doc_id", "left_semi")
    chunks = chunk_pages(pages, **options).join(named, "doc_id")
    if buckets:  # sized by the pages, so that they are not chunked twice
        chunks = spread_documents(chunks, buckets, files_per_bucket or files_for(pages, buckets))
    return embed(chunks, model=model)
