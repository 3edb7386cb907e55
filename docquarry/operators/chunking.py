"""Documents and pages to chunks, and the gates around an upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators.scans import (
    LARGE_KEY_ROWS,
    PART_BYTES,
    all_ordinary,
    block_of,
    by_block,
    concat_in_order,
    in_parts,
    large_keys,
    running_total,
)

PAGES_PER_BLOCK = 1024  # of one document in a task


def chunk_text(
    docs: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    chunk_size: int = tx.CHUNK_SIZE,
    overlap: int = tx.CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk: the document's columns with ``text`` replaced by the
    chunk's, plus ``chunk_index``, ``chunk_id`` and a null ``page``.

    Row-local: no shuffle. Blank documents give no rows.
    """
    split = tx.split_pieces(chunk_size, overlap)
    kept = [c for c in docs.columns if c != text_col]
    pieces = docs.select(*kept, split(tx.normalize_text(F.col(text_col))).alias("_pieces"))
    return explode_pieces(pieces, "chunk_index", text_col).select(
        *kept,
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.concat(F.lit("chunk-"), F.col("chunk_index")).alias("chunk_id"),
        F.lit(None).cast("bigint").alias("page"),
        text_col,
    )


def explode_pieces(pieces: DataFrame, position: str, text_col: str) -> DataFrame:
    """One row per piece. A plain posexplode would make Spark test the array's
    size below it, which means running the Python split a second time; the
    outer form with a filter on the result does not."""
    kept = [c for c in pieces.columns if c != "_pieces"]
    rows = pieces.select(*kept, F.posexplode_outer("_pieces").alias(position, text_col))
    return rows.filter(F.col(text_col).isNotNull())


def chunk_pages(
    pages: DataFrame,
    doc_col: str = "doc_id",
    page_col: str = "page",
    text_col: str = "text",
    chunk_size: int = tx.CHUNK_SIZE,
    overlap: int = tx.CHUNK_OVERLAP,
    large_key_rows: int = LARGE_KEY_ROWS,
) -> DataFrame:
    """Chunk each page on its own; ``chunk_index`` runs on over the document.

    The index is a running total of chunks per page; a document with very many
    pages is spread over many tasks. Rows with one page number follow each other by
    a hash of their text, and those without a number come first.
    """
    split = tx.split_pieces(chunk_size, overlap)
    page = F.col(page_col)

    def pieces_of(some: DataFrame) -> DataFrame:
        return some.select(doc_col, page_col, F.xxhash64(text_col).alias("_text"), split(tx.normalize_text(F.col(text_col))).alias("_pieces"))

    large = large_keys(pages, [doc_col], page, large_key_rows)
    large_rows = None
    if large is not None:  # only pages of large documents are split twice
        large_rows = pieces_of(pages.join(F.broadcast(large.select(doc_col)), doc_col, "left_semi"))
    count = F.size("_pieces").cast("bigint")
    counted = running_total(pieces_of(pages), [doc_col], [page_col, "_text"], count, "_through", page, large, large_rows, together=False)
    before = F.col("_through") - F.size("_pieces")
    index = F.col("_before") + F.col("_pos")
    rows = explode_pieces(counted.select(doc_col, page_col, before.alias("_before"), "_pieces"), "_pos", text_col)
    return rows.select(
        doc_col,
        index.alias("chunk_index"),
        F.concat(F.lit("chunk-"), index).alias("chunk_id"),
        F.col(page_col).cast("bigint").alias("page"),
        text_col,
    )


def merge_pages(
    pages: DataFrame,
    doc_col: str = "doc_id",
    page_col: str = "page",
    text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Page texts joined by a blank line, trimmed as a whole.

    Rows are (document, part, text): a document below ``part_bytes``
    is the single part 0, a longer one continues in the next parts, and the
    parts put together in order are the whole text. Blank pages before the
    first and after the last page with text fall away; a document of blank
    pages gives one empty part.

    If every document is below ``part_bytes``, one aggregate does it; else pages are placed in blocks and parts.
    """
    page = F.col(page_col)
    pages = pages.withColumn(page_col, F.coalesce(page, F.lit(-1)))  # a page without a number comes first
    if all_ordinary(pages, [doc_col], text_col, part_bytes):
        return _merged_whole(pages, doc_col, page_col, text_col)
    filled = F.when(~tx.is_blank(F.col(text_col)), page)
    blocked = by_block(
        pages.select(doc_col, page_col, text_col, block_of(page, PAGES_PER_BLOCK).alias("_block")), [doc_col], "_block"
    )
    whole = Window.partitionBy(doc_col)
    ends = (
        blocked.groupBy(doc_col, "_block")
        .agg(F.min(filled).alias("_low"), F.max(filled).alias("_high"), F.min(page_col).alias("_page"))
        .select(
            doc_col,
            "_block",
            F.coalesce(F.min("_low").over(whole), F.min("_page").over(whole)).alias("_first"),
            F.coalesce(F.max("_high").over(whole), F.min("_page").over(whole)).alias("_last"),
        )
    )
    chars = F.lit(tx.TRIM_CHARS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(page == F.col("_first"), F.ltrim(text, chars)).otherwise(text)
    text = F.when(page == F.col("_last"), F.rtrim(text, chars)).otherwise(text)
    joint = F.when(page > F.col("_first"), F.lit("\n\n")).otherwise(F.lit(""))
    lines = (
        blocked.join(ends, [doc_col, "_block"])
        .filter(page.between(F.col("_first"), F.col("_last")))
        .select(doc_col, page_col, F.concat(joint, text).alias("_line"))
    )
    placed = in_parts(lines, [doc_col], page_col, "_line", part_bytes)
    return concat_in_order(placed, [doc_col, "part"], page_col, "_line", "", text_col)


def _merged_whole(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """``merge_pages`` of documents that one task may hold: their pages are sorted inside the aggregate."""
    chars = F.lit(tx.TRIM_CHARS)
    row = F.struct(F.col(page_col).alias("page"), F.coalesce(text_col, F.lit("")).alias("text"), (~tx.is_blank(F.col(text_col))).alias("filled"))
    sorted_pages = pages.groupBy(doc_col).agg(F.array_sort(F.collect_list(row)).alias("_pages"))
    filled = F.filter("_pages", lambda p: p["filled"])
    ends = sorted_pages.withColumn("_filled", filled).select(
        doc_col, "_pages",
        F.coalesce(F.get("_filled", F.lit(0))["page"], F.get("_pages", F.lit(0))["page"]).alias("_first"),
        F.coalesce(F.get("_filled", F.size("_filled") - 1)["page"], F.get("_pages", F.lit(0))["page"]).alias("_last"))

    def line(p):
        text = F.when(p["page"] == F.col("_first"), F.ltrim(p["text"], chars)).otherwise(p["text"])
        text = F.when(p["page"] == F.col("_last"), F.rtrim(text, chars)).otherwise(text)
        return F.concat(F.when(p["page"] > F.col("_first"), F.lit("\n\n")).otherwise(F.lit("")), text)

    inside = F.filter("_pages", lambda p: p["page"].between(F.col("_first"), F.col("_last")))
    return ends.select(doc_col, F.lit(0).cast("bigint").alias("part"), F.array_join(F.transform(inside, line), "").alias(text_col))


def chunk_counts(chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    return chunks.groupBy(doc_col).agg(F.count("*").alias("chunk_count"))


def extension_gate(docs: DataFrame, name_col: str = "file_name") -> DataFrame:
    return docs.withColumn("supported", tx.has_supported_extension(F.col(name_col)))


def ingest_gate(
    docs: DataFrame,
    chunks: DataFrame | None = None,
    doc_col: str = "doc_id",
    name_col: str = "file_name",
    text_col: str = "text",
    readable_col: str | None = None,
) -> DataFrame:
    """Status of each uploaded document; the first failing check names it.

    ``invalid`` no file at all (null name), ``unsupported`` extension,
    ``unreadable`` (null text, or ``readable_col`` false), ``empty``,
    ``no_chunks``, else ``ready``.

    Chunks of plain texts are counted in place, without a shuffle. For paged
    documents give their ``chunks``, which are counted and joined.
    """
    readable = F.col(text_col).isNotNull()
    if readable_col:
        readable = readable & F.coalesce(F.col(readable_col), F.lit(False))
    # only texts that pass the other checks are split
    wanted = tx.has_supported_extension(F.col(name_col)) & readable
    facts = docs.select(
        doc_col,
        name_col,
        F.col(name_col).isNull().alias("_nameless"),
        tx.has_supported_extension(F.col(name_col)).alias("_supported"),
        readable.alias("_readable"),
        tx.is_blank(F.col(text_col)).alias("_blank"),
        *([] if chunks is not None else [tx.count_pieces()(F.when(wanted, tx.normalize_text(F.col(text_col)))).alias("chunk_count")]),
    )
    if chunks is not None:
        facts = facts.join(chunk_counts(chunks, doc_col), doc_col, "left")
    status = (
        F.when(F.col("_nameless"), "invalid")
        .when(~F.col("_supported"), "unsupported")
        .when(~F.col("_readable"), "unreadable")
        .when(F.col("_blank"), "empty")
        .when(F.coalesce(F.col("chunk_count"), F.lit(0)) == 0, "no_chunks")
        .otherwise("ready")
    )
    return facts.select(
        doc_col,
        name_col,
        status.alias("status"),
        F.when(status == "ready", F.col("chunk_count")).otherwise(F.lit(0)).cast("bigint").alias("chunk_count"),
    )
