"""Exact cosine top-k for many questions at once.

Chunks are never shuffled and never joined to questions. Questions go to the
tasks in blocks of a fixed byte size; each task multiplies its chunk batches
with a block and keeps k candidates per question, and one small shuffle by
question merges the candidates. More questions mean more blocks: those are
written to the shared folder, and a task reads one after the other for a
buffer of chunks, in one scan of the chunk table.

Scores are rounded to 6 places before ranking, so that neither partitioning
nor a retried task can change an answer. Ties go to the newest document when
``newest_col`` is given, then to the lower ``doc_id`` and ``chunk_index``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import trim_text
from docquarry.operators.scoring import BlockScorer, SharedBlockScorer
from docquarry.session import work_dir
from docquarry.sources.shared import filtered_by_parts, write_parts

DEFAULT_K = 3  # Fixed value: chunks retrieved per question.
BLOCK_BYTES = 64 * 1024 * 1024
FEW_QUERIES = 2048
INLINE_SCOPES = 1000
BROADCAST_ROWS = 100_000  # rows of two or three narrow columns


def _unscoped(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lit(None).cast("string").alias("scope"), "embedding")


def _scoped(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    doc_type = chunks.schema["doc_id"].dataType
    return queries.select("query_id", F.col("scope").try_cast(doc_type).alias("scope"), "embedding")


def _score(
    queries: DataFrame,
    chunks: DataFrame,
    k: int | None,
    per_document: bool = False,
    newest_col: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    buckets: int | None = None,
) -> DataFrame:
    """Candidates of all tasks, not yet merged.

    ``buckets`` is the bucket count of a store that ``chunks`` come from: scoped
    questions then open the buckets of their documents only.

    Questions are fetched in one go when they are few; else tasks read them
    in blocks sized by a count. A question or chunk without an id is an error.
    """
    spark = queries.sparkSession
    tie_cols = [newest_col] if newest_col else []
    chunk_cols = [*tie_cols, "doc_id", "chunk_index"]
    fields = [queries.schema["query_id"], *(chunks.schema[c] for c in chunk_cols)]
    # Not null, so that no later join adds a null test below the merge's
    # exchange, which would keep two uses of the hits from sharing it.
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType, f.name == newest_col) for f in fields]
        + [T.StructField("score", T.DoubleType(), False)]
    )
    ties = [(c, "descending") for c in tie_cols] + [("doc_id", "ascending"), ("chunk_index", "ascending")]

    named = F.when(F.col("query_id").isNull(), F.raise_error(F.lit("a question without an id"))).otherwise(F.col("query_id"))
    queries = queries.withColumn("query_id", named)
    first = queries.limit(FEW_QUERIES + 1).toArrow()
    if first.num_rows == 0:
        return spark.createDataFrame([], out_schema)
    bucketed = ["doc_bucket"] if buckets and "doc_bucket" in chunks.columns else []
    slim = chunks.select(*chunk_cols, "embedding", *bucketed)
    if first.num_rows > FEW_QUERIES or first.nbytes > block_bytes:
        dim = max(map(len, filter(None, first.column("embedding").to_pylist())), default=0)
        return _score_blocks(queries, slim, k, per_document, ties, out_schema, block_bytes, dim, buckets if bucketed else None)
    scopes = set(first.column("scope").to_pylist())
    source = slim
    if None not in scopes:
        # Reaches the scan: partition, file and row-group pruning.
        kind = chunks.schema["doc_id"].dataType
        if bucketed:
            held = [F.pmod(F.xxhash64(F.lit(s).cast(kind)), F.lit(buckets)).cast("int") for s in sorted(scopes)]
            source = source.filter(F.col("doc_bucket").isin(held))
        if len(scopes) <= INLINE_SCOPES:
            source = source.filter(F.col("doc_id").isin(sorted(scopes)))
        else:  # no larger than the block; keeps other documents' vectors in the JVM
            known = spark.createDataFrame([(s,) for s in scopes], T.StructType([chunks.schema["doc_id"]]))
            source = source.join(F.broadcast(known), "doc_id", "left_semi")
    sent = spark.sparkContext.broadcast(first)
    return source.drop("doc_bucket").mapInArrow(BlockScorer(sent, k, per_document, ties), out_schema)


def _score_blocks(
    queries: DataFrame,
    slim: DataFrame,
    k: int | None,
    per_document: bool,
    ties: list[tuple[str, str]],
    out_schema: T.StructType,
    block_bytes: int,
    dim: int,
    buckets: int | None,
) -> DataFrame:
    """Many questions: written once in blocks to the shared folder, from which tasks read them one at a
    time, so that the chunks are scanned once and no block passes the driver.

    If all questions are scoped, their documents' buckets prune the scan at run time, however many they are.
    Where tasks cannot open the shared folder, blocks are broadcast, one scan each.
    """
    count = queries.select("query_id").count()
    blocks = max(1, -(-count * max(dim, 1) * 8 // block_bytes))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    written = write_parts(queries, number, "questions")
    source = slim
    if written is not None:
        asked = written[1].select(F.col("scope").alias("doc_id"))
        if asked.filter("doc_id IS NULL").isEmpty():
            source = _in_scopes(slim, asked, buckets)
        scorer = SharedBlockScorer(written[0], k, per_document, ties)
        return source.drop("doc_bucket").mapInArrow(lambda batches: scorer(batches), out_schema)
    spark, parts = queries.sparkSession, []
    for table in _fetch_blocks(queries, blocks, count):
        sent = spark.sparkContext.broadcast(table)
        parts.append(source.drop("doc_bucket").mapInArrow(BlockScorer(sent, k, per_document, ties), out_schema))
    return reduce(DataFrame.unionAll, parts)


def _in_scopes(slim: DataFrame, asked: DataFrame, buckets: int | None) -> DataFrame:
    """Chunks of the documents asked for, as far as those are few enough to broadcast; the scorer finds the rest."""
    on = ["doc_id"]
    if buckets:
        # the comparison always holds; it tells the optimizer that this side selects, so that it prunes partitions by it
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        asked, on = asked.withColumn("doc_bucket", bucket).filter(F.col("doc_bucket") >= 0), ["doc_bucket", "doc_id"]
    asked = asked.distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return slim
    return slim.join(F.broadcast(asked), on, "left_semi")


def _fetch_blocks(queries: DataFrame, blocks: int, count: int) -> Iterator[pa.Table]:
    """All questions, a block at a time, through the driver.

    Questions are written once, with their vectors, so that no block embeds them again.
    """
    spark, schema = queries.sparkSession, queries.schema
    path = work_dir(spark, "questions")
    queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).write.partitionBy("_block").parquet(path)
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("_block", T.LongType())])).parquet(path)
    # Distinct ids hash evenly; the limit keeps any block bounded regardless.
    most = 2 * -(-count // blocks) + 1000
    for number in range(blocks):
        table = written.filter(F.col("_block") == number).select(*schema.names).limit(most + 1).toArrow()
        if table.num_rows > most:
            raise ValueError("query ids must be unique")
        yield table


def _merge(found: DataFrame, k: int, groups: list[str], newest_col: str | None) -> DataFrame:
    order = [F.desc("score"), *([F.desc(newest_col)] if newest_col else []), "doc_id", "chunk_index"]
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    kept = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return kept.select("query_id", "doc_id", "chunk_index", "score", F.col("rank").cast("bigint").alias("rank"))


def cosine_scores(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Score of every chunk against the queries scoped to its document.

    ``queries(query_id, scope, embedding)``; a null scope scores nothing: those
    questions are for the top-k forms, whose output is bounded.
    """
    found = _score(_scoped(queries, chunks).filter(F.col("scope").isNotNull()), chunks, k=None, **options)
    return found.select("query_id", "doc_id", "chunk_index", "score")


def top_k(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, newest_col: str | None = None, **options) -> DataFrame:
    """Best k chunks over all documents for each question.

    Equal to the best k of each document, merged and cut to k.
    """
    found = _score(_unscoped(queries), chunks, k, newest_col=newest_col, **options)
    return _merge(found, k, ["query_id"], newest_col)


def top_k_in_document(
    queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, newest_col: str | None = None, **options
) -> DataFrame:
    """Best k chunks of the one document named by each question's ``scope``."""
    named = _scoped(queries, chunks).filter(F.col("scope").isNotNull())
    found = _score(named, chunks, k, newest_col=newest_col, **options)
    return _merge(found, k, ["query_id"], newest_col)


def top_k_per_document(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, **options) -> DataFrame:
    """Best k chunks of every document, ranked within question and document."""
    found = _score(_unscoped(queries), chunks, k, per_document=True, **options)
    return _merge(found, k, ["query_id", "doc_id"], None)


def has_document(registry: DataFrame) -> Column:
    """True when any document is registered; a one-row subquery, not a join."""
    return F.coalesce(registry.limit(1).select(F.lit(True)).scalar(), F.lit(False))


def hint_small(df: DataFrame, at_most: int | None) -> DataFrame:
    """Broadcast a table of narrow rows whose row count has a known, small bound."""
    return F.broadcast(df) if at_most is not None and at_most <= BROADCAST_ROWS else df


def registered_chunks(chunks: DataFrame, registry: DataFrame, buckets: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Chunks of registered documents, without shuffling vectors.

    Either the registry or the set of chunk documents missing from it is
    usually small; counting the two (document ids only, up to the bound) picks
    the one to broadcast. When neither is, the tasks that read a bucket of a store
    (``buckets``) meet the registry's rows of that bucket there. Only a table without buckets is joined by shuffling.
    """
    known = registry.select("doc_id")
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return chunks.join(F.broadcast(known), "doc_id", "left_semi")
    missing = chunks.select("doc_id").distinct().join(known, "doc_id", "left_anti")
    unknown = missing.limit(broadcast_rows + 1).count()
    if unknown == 0:
        return chunks
    if unknown <= broadcast_rows:
        return chunks.join(F.broadcast(missing), "doc_id", "left_anti")
    met = None
    if buckets and "doc_bucket" in chunks.columns:
        met = filtered_by_parts(chunks, known, ["doc_id"], F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), keep=True)
    return chunks.join(known, "doc_id", "left_semi") if met is None else met


def scoped_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    registry: DataFrame,
    k: int = DEFAULT_K,
    newest_col: str | None = None,
    **options,
) -> DataFrame:
    """Each question in its own scope.

    A blank or null ``scope`` searches the registered documents; a given one
    searches that document whether registered or not. With an empty registry
    no question is answered.
    """
    asked = queries.withColumn("scope", F.nullif(trim_text(F.col("scope").cast("string")), F.lit("")))
    asked = asked.filter(has_document(registry))
    everywhere = top_k(
        asked.filter(F.col("scope").isNull()),
        registered_chunks(chunks, registry, options.get("buckets")),
        k,
        newest_col=newest_col,
        **options,
    )
    return everywhere.unionByName(top_k_in_document(asked, chunks, k, newest_col=newest_col, **options))


def attach_text(hits: DataFrame, chunks: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Fetch the text columns of hits, after ranking, so that text takes no part
    in it. ``max_hits`` (questions x k) allows a broadcast when it is small."""
    wanted = [c for c in ("chunk_id", "text", "file_name", "page") if c in chunks.columns]
    slim = chunks.select("doc_id", "chunk_index", *wanted)
    return slim.join(hint_small(hits, max_hits), ["doc_id", "chunk_index"])


def source_rows(hits: DataFrame) -> DataFrame:
    """Hits as answer sources: missing text, index and name get defaults, the
    page may be null, vectors are left out."""
    have = set(hits.columns)
    index = F.coalesce(F.col("chunk_index"), F.lit(0)).cast("bigint")
    name = F.coalesce(F.col("file_name"), F.lit("")) if "file_name" in have else F.lit("")
    page = F.col("page") if "page" in have else F.lit(None)
    return hits.select(
        "query_id",
        "rank",
        F.concat(F.lit("chunk-"), index.cast("string")).alias("chunk_id"),
        "score",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        index.alias("chunk_index"),
        "doc_id",
        name.alias("file_name"),
        page.cast("bigint").alias("page"),
    )
