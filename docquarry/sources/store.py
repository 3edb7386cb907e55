"""The chunk-vector store: append-only Parquet, the latest upload of a document wins.

Layout below the store's path::

    layout/                                    number of document buckets
    claims/<n>                                 one empty file per batch number given out
    chunks/batch_id=<n>/doc_bucket=<b>/        chunk rows with vectors
    documents/batch_id=<n>/source=<writer>-<m>/  documents saved or deleted by the batch

A batch is named by its writer and the writer's own number for it, and gets the
store's next batch number. Written again under the same name it replaces itself
whole; batches of other writers are never touched. A batch counts once
its ``documents`` rows are there, so what a failed write left behind is not read.

``documents`` is narrow: one row per document and batch. Versions, deletes and
the registry are resolved on it alone; chunk rows only meet the versions that
no longer live.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.sources.shared import filtered_by_parts

DOC_BUCKETS = 64
CHUNKS_PER_FILE_BLOCK = 4096
FILE_TEXT_BYTES = 32 << 20  # of the texts whose chunks go to one file, unless the number of files is given
BROADCAST_BYTES = 32 << 20
VERSION_BYTES = 64  # of a (document, batch) row in a broadcast, generously

# of a store that has no chunk yet; doc_id is of the store's type
CHUNK_SCHEMA = "chunk_index bigint, chunk_id string, page bigint, text string, file_name string, uploaded_at timestamp, embedding array<float>, doc_bucket int, batch_id bigint"


def doc_bucket(doc_id: Column, buckets: int = DOC_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def _block() -> Column:
    return F.floor(F.col("chunk_index") / F.lit(CHUNKS_PER_FILE_BLOCK))


def _gathered(df: DataFrame, buckets: int, files_per_bucket: int) -> DataFrame:
    """One partition per file: a share of a bucket's documents, or of the blocks of their chunks."""
    share = F.pmod(F.hash("doc_id", *([_block()] if "chunk_index" in df.columns else [])), F.lit(files_per_bucket))
    return df.repartitionById(buckets * files_per_bucket, (doc_bucket(F.col("doc_id"), buckets) * files_per_bucket + share).cast("int"))


def files_for(texts: DataFrame, buckets: int, text_col: str = "text", file_bytes: int = FILE_TEXT_BYTES) -> int:
    """Files per bucket for the chunks of ``texts``: as many as keep each at about ``file_bytes`` of text, by one pass over their sizes."""
    total = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // (buckets * file_bytes)))


def spread_documents(docs: DataFrame, buckets: int = DOC_BUCKETS, files_per_bucket: int | None = None) -> DataFrame:
    """Bring documents of one bucket together before they are chunked.

    Vectors take several times the space of their text, so the shuffle that
    gives tidy store files is cheaper here than after embedding. There are
    ``buckets * files_per_bucket`` tasks, one file each; without ``files_per_bucket`` as many as the texts need, see ``files_for``.
    """
    return _gathered(docs, buckets, files_per_bucket or files_for(docs, buckets))


# --- batches ------------------------------------------------------------------

def _listed(spark: SparkSession, pattern: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [status.getPath().toString() for status in found or []]


def _create(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(target)


def committed_batches(spark: SparkSession, path: str) -> dict[str, int]:
    """Batch numbers by source, of the batches that are complete."""
    found = {}
    for folder in _listed(spark, f"{path}/documents/batch_id=*/source=*/_SUCCESS"):
        number, source = re.search(r"batch_id=(\d+)/source=([^/]+)/", folder).groups()
        found[source] = int(number)
    return found


def _claim(spark: SparkSession, path: str, source: str) -> int:
    """The number of this source's batch, or the next free one, given to nobody else."""
    known = committed_batches(spark, path).get(source)
    if known is not None:
        return known
    number = max([int(claim.rsplit("/", 1)[1]) for claim in _listed(spark, f"{path}/claims/*")], default=-1) + 1
    while not _create(spark, f"{path}/claims/{number}"):
        number += 1
    return number


def _source(writer: str, number: int) -> str:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.]*", writer):
        raise ValueError("a writer is named by letters, digits, _ and ., a letter first")
    return f"{writer}-{number}"


def _layout(spark: SparkSession, path: str):
    return spark.read.schema("buckets int, id_type string").parquet(f"{path}/layout").first()


def store_buckets(spark: SparkSession, path: str) -> int:
    return _layout(spark, path).buckets


def _lay_out(docs: DataFrame, path: str, buckets: int | None) -> int:
    """The store's bucket count and type of ids, fixed by its first batch."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if _listed(spark, f"{path}/layout/_SUCCESS"):
        known = _layout(spark, path)
        if buckets not in (None, known.buckets) or id_type != known.id_type:
            raise ValueError(f"the store has {known.buckets} buckets and ids of type {known.id_type}, not {buckets} and {id_type}")
        return known.buckets
    buckets = buckets or DOC_BUCKETS
    row = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return buckets


def save_chunks(
    chunks: DataFrame,
    path: str,
    batch_id: int,
    buckets: int | None = None,
    gather: bool = False,
    files_per_bucket: int | None = None,
    writer: str = "batch",
) -> None:
    """Add the writer's batch ``batch_id`` of embedded chunks, or replace it whole.

    ``gather`` shuffles by bucket first, for input not prepared by
    ``spread_documents``. Without ``files_per_bucket`` Spark divides large buckets and joins small ones by their
    shuffled size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``); with it, blocks of a large document go to several tasks.
    """
    spark = chunks.sparkSession
    source = _source(writer, batch_id)
    buckets = _lay_out(chunks, path, buckets)
    number = _claim(spark, path, source)
    rows = chunks.drop("batch_id").withColumn("doc_bucket", doc_bucket(F.col("doc_id"), buckets))
    if gather:
        rows = _gathered(rows, buckets, files_per_bucket) if files_per_bucket else rows.hint("rebalance", "doc_bucket")
    target = f"{path}/chunks/batch_id={number}"
    ordered = rows.sortWithinPartitions("doc_bucket", "doc_id", "chunk_index")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("doc_bucket").parquet(target)
    saved = spark.read.schema(rows.schema).parquet(target)
    have = set(saved.columns)
    told = saved.groupBy("doc_id").agg(
        (F.max("file_name") if "file_name" in have else F.lit(None)).cast("string").alias("file_name"),
        (F.max("uploaded_at") if "uploaded_at" in have else F.lit(None)).cast("timestamp").alias("uploaded_at"),
        F.count("*").alias("chunk_count"), F.min("doc_bucket").alias("doc_bucket"))
    told.withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{path}/documents/batch_id={number}/source={source}")


def delete_documents(doc_ids: DataFrame, path: str, batch_id: int, writer: str = "delete") -> None:
    """Mark documents deleted; what later batches write for them survives."""
    spark = doc_ids.sparkSession
    source = _source(writer, batch_id)
    buckets = _lay_out(doc_ids, path, None)
    number = _claim(spark, path, source)
    gone = doc_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    gone.select(
        "doc_id", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("timestamp").alias("uploaded_at"),
        F.lit(0).cast("bigint").alias("chunk_count"), doc_bucket(F.col("doc_id"), buckets).alias("doc_bucket"), F.lit(True).alias("deleted"),
    ).write.mode("overwrite").parquet(f"{path}/documents/batch_id={number}/source={source}")


# --- versions -----------------------------------------------------------------

def dead_versions(versions: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """(doc_id, batch_id) of ``versions`` that a later version or delete of the document replaced.

    Both tables are narrow: (doc_id, batch_id), one row per document and batch.
    """
    rows = versions.select("doc_id", "batch_id", F.lit(False).alias("deleted"))
    if deletes is not None:
        rows = rows.unionByName(deletes.select("doc_id", "batch_id", F.lit(True).alias("deleted")))
    # a delete and an upload of one batch: the delete came after it
    latest = rows.groupBy("doc_id").agg(F.max(F.struct("batch_id", "deleted")).alias("_last"))
    return rows.filter("NOT deleted").distinct().join(latest, "doc_id").filter(
        (F.col("batch_id") < F.col("_last.batch_id")) | F.col("_last.deleted")).select("doc_id", "batch_id")


def without_dead(chunks: DataFrame, dead: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, buckets: int | None = None) -> DataFrame:
    """Chunk rows of versions that live.

    The dead versions are counted: while small they are broadcast. Beyond that, batches without dead
    versions pass through, and in the others the tasks that read a bucket of a store (``buckets``)
    meet the dead versions of that bucket there. No vector is shuffled; only a table without buckets is joined by shuffling.
    """
    count = dead.count()
    if count == 0:
        return chunks
    if count * VERSION_BYTES <= broadcast_bytes:
        return chunks.join(F.broadcast(dead), ["doc_id", "batch_id"], "left_anti")
    touched = [r.batch_id for r in dead.select("batch_id").distinct().collect()]  # one row per batch
    among = F.col("batch_id").isin(touched)
    met = None
    if buckets and "doc_bucket" in chunks.columns:
        met = filtered_by_parts(chunks.filter(among), dead, ["doc_id", "batch_id"], doc_bucket(F.col("doc_id"), buckets), keep=False)
    if met is None:
        met = chunks.filter(among).join(dead, ["doc_id", "batch_id"], "left_anti")
    return chunks.filter(~among).unionByName(met)


def without_deleted(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drop rows written at or before their document's latest delete."""
    last = tombstones.groupBy("doc_id").agg(F.max("batch_id").alias("_deleted_at"))
    versions = chunks.select("doc_id", "batch_id").distinct()
    return without_dead(chunks, versions.join(last, "doc_id").filter("batch_id <= _deleted_at").select("doc_id", "batch_id"))


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """All chunks of the newest batch of each document; older uploads of it are gone whole."""
    return without_dead(chunks, dead_versions(chunks.select("doc_id", "batch_id").distinct()))


# --- reading ------------------------------------------------------------------

def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The ``documents`` table of the complete batches."""
    # A given schema, because a batch of no documents leaves no file to infer one from.
    schema = (f"doc_id {_layout(spark, path).id_type}, file_name string, uploaded_at timestamp, chunk_count bigint, "
              "doc_bucket int, deleted boolean, batch_id bigint, source string")
    folders = [f"{path}/documents/batch_id={number}/source={source}" for source, number in committed_batches(spark, path).items()]
    if not folders:
        return spark.createDataFrame([], schema).drop("source")
    return spark.read.schema(schema).option("basePath", f"{path}/documents").parquet(*folders).drop("source")


def read_chunks(spark: SparkSession, path: str, only: Column | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The live chunks of a store. ``only`` narrows whole documents, by doc_id and doc_bucket, before
    versions are resolved, so that it prunes every scan. A store without any chunk gives no rows."""
    if not _listed(spark, f"{path}/chunks/batch_id=*/doc_bucket=*"):
        return spark.createDataFrame([], f"doc_id {_layout(spark, path).id_type}, {CHUNK_SCHEMA}")
    versions = read_versions(spark, path)
    complete = sorted(committed_batches(spark, path).values())
    chunks = spark.read.parquet(f"{path}/chunks").withColumn("batch_id", F.col("batch_id").cast("bigint")).filter(F.col("batch_id").isin(complete))
    if only is not None:
        chunks, versions = chunks.filter(only), versions.filter(only)
    dead = dead_versions(versions.filter("NOT deleted"), versions.filter("deleted"))
    return without_dead(chunks, dead, broadcast_bytes, store_buckets(spark, path))


def documents_filter(spark: SparkSession, path: str, doc_ids: list) -> Column:
    """A condition for some documents that names their buckets too, so that a scan opens no other."""
    id_type = _layout(spark, path).id_type
    # The hash that names a bucket depends on the id's type, not only its value.
    wanted = [F.lit(doc_id).cast(id_type) for doc_id in doc_ids]
    buckets = store_buckets(spark, path)
    return F.col("doc_bucket").isin([doc_bucket(doc_id, buckets) for doc_id in wanted]) & F.col("doc_id").isin(wanted)


def read_documents(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """The live chunks of some documents; buckets of others are not read."""
    return read_chunks(spark, path, documents_filter(spark, path, doc_ids))


# --- registry -----------------------------------------------------------------

def registry(chunks: DataFrame) -> DataFrame:
    """(doc_id, file_name, uploaded_at, chunk_count) of a table of live chunks."""
    return chunks.groupBy("doc_id").agg(
        F.max_by("file_name", "batch_id").alias("file_name"),
        F.max("uploaded_at").alias("uploaded_at"),
        F.count("*").alias("chunk_count"),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The documents that live now, from the narrow table alone: it follows every save and delete."""
    newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch_id"), F.desc("deleted")))
    live = read_versions(spark, path).withColumn("_n", newest).filter("_n = 1 AND NOT deleted")
    return live.select("doc_id", "file_name", "uploaded_at", "chunk_count")


def list_documents(documents: DataFrame) -> DataFrame:
    """The registry, newest upload first."""
    return documents.orderBy(F.desc("uploaded_at"), "doc_id")


def compact(
    spark: SparkSession,
    path: str,
    new_path: str,
    batch_id: int,
    buckets: int | None = None,
    files_per_bucket: int | None = None,
) -> None:
    """Write the live rows as one batch of a new store at ``new_path``.

    The old path is left alone, so readers of it are not disturbed; switch
    them over and retire the old path afterwards.
    """
    live = read_chunks(spark, path).drop("batch_id", "doc_bucket")
    save_chunks(live, new_path, batch_id, buckets or store_buckets(spark, path), gather=True, files_per_bucket=files_per_bucket)
