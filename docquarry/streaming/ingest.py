"""Continuous ingest: new documents are gated, chunked, embedded and stored."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.embedding import ModelFactory
from docquarry.plans.ingest import embedded_documents, embedded_pages
from docquarry.sources.store import save_chunks
from docquarry.streaming.writers import writer_of


def once_per_upload(docs: DataFrame, lateness: str = "1 day", keys: tuple[str, ...] = ("upload_id", "file_name")) -> DataFrame:
    """Streaming uploads without those delivered again within ``lateness`` of their first delivery.

    Spark keeps the keys of that time. It is told by the clock of the micro-batch, not by the upload's own time, so that
    an upload whose first delivery comes late, or that has no time, is not lost.
    """
    arrived = docs.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", lateness)
    return arrived.dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")


def start_ingest(
    docs: DataFrame,
    store_path: str,
    checkpoint: str,
    model: ModelFactory | None = None,
    buckets: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query from a streaming ``docs`` table into the store.

    A document comes with a ``text``, or, decoded by page, with ``pages``, an array of (page, text) structs.

    Batches are named by the checkpoint's writer id and the micro-batch number: one
    replayed after a failure replaces its own rows, and no others.
    """
    writer = writer_of(docs.sparkSession, checkpoint)

    def add(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # sized, then stored, but read and told apart once
        try:
            if "pages" in batch.columns:
                pages = batch.select("doc_id", F.inline("pages"))
                ready = embedded_pages(pages, batch.select("doc_id", "file_name", "uploaded_at"), model, buckets=buckets)
            else:
                ready = embedded_documents(batch, model, buckets=buckets)
            save_chunks(ready, store_path, batch_id, buckets, writer=writer)
        finally:
            batch.unpersist()
            docs.sparkSession._jvm.System.gc()  # shuffle files of micro-batches before go when the driver collects its garbage, which it seldom needs to

    return (
        docs.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
