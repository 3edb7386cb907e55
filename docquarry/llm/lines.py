"""Line deduplication across documents, returned as compressed keep bitmaps.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of at least ``shortest`` code points lose all their lines except those in
the document with the smallest doc_id. Keys (as 128-bit hashes) are dealt out
by range, sorted by document within a partition, and streamed once; what comes
back is a bitmap of lines per document, never text.

A task first settles the keys that several documents of its own piece share:
only the smallest of them goes on, so that a key found everywhere sends one row
per piece.

Defined results: null and empty texts are one empty line; rows without a
doc_id stay as they are and hold no key; rows with the same doc_id are one
document as a holder, and each row is cut by its own text; an empty table gives
no rows; columns of the input with the names of new columns are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.arrays import mix, pieces

SHORTEST = 10
_CONTINUATION = bytes(range(0x80, 0xC0))
_DROPS = "doc_id long, tag long, drops binary"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def packed(lines: np.ndarray) -> bytes:
    """Line numbers as a compressed bitmap."""
    flags = np.zeros(int(lines.max()) + 1, bool)
    flags[lines] = True
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def unpacked(bitmaps: list[bytes], size: int) -> np.ndarray:
    """The union of compressed bitmaps as ``size`` flags."""
    flags = np.zeros(size, bool)
    for bitmap in bitmaps:
        own = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:size].astype(bool)
        flags[: len(own)] |= own
    return flags


def _keys(shortest: int):
    """(hi, lo, doc_id, tag, lines, settled) of the eligible lines of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for table in pieces(batches):
            hashes, owners, numbers = [], [], []
            for row, text in enumerate(table.column("text").to_pylist()):
                for number, line in enumerate(text.split(b"\n")):
                    if len(line) < shortest:
                        continue
                    key = line_key(line)
                    if len(key) >= shortest and len(key.translate(None, _CONTINUATION)) >= shortest:
                        hashes.append(digest(key))
                        owners.append(row)
                        numbers.append(number)
            if not hashes:
                continue
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            rows, lines = np.array(owners), np.array(numbers, np.int32)
            doc, tag = (table.column(c).to_numpy()[rows] for c in ("doc_id", "tag"))
            order = np.lexsort((lines, tag, doc, pair[:, 1], pair[:, 0]))
            hi, lo, doc, tag, lines = pair[order, 0], pair[order, 1], doc[order], tag[order], lines[order]
            new_key = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
            least = doc[np.flatnonzero(new_key)][np.cumsum(new_key) - 1]
            new_row = new_key | np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
            at = np.flatnonzero(new_row)
            offsets = pa.array(np.r_[at, len(lines)].astype(np.int32))
            settled = (doc > least)[at]
            # what is settled needs no company of its key: it is spread by document instead
            spread = mix((hi[at] ^ doc[at]).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(settled, spread, hi[at])), pa.array(lo[at]), pa.array(doc[at]), pa.array(tag[at]),
                 pa.ListArray.from_arrays(offsets, pa.array(lines)), pa.array(settled)],
                ["hi", "lo", "doc_id", "tag", "lines", "settled"])

    return run


def _losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by key and document: all but a key's first document lose its lines."""
    last = holder = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc, tag = (batch.column(i).to_numpy() for i in range(4))
        settled = batch.column(5).to_numpy(zero_copy_only=False)
        new = np.r_[last != (hi[0], lo[0]), (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        starts = np.flatnonzero(new)
        number = np.cumsum(new)
        first = np.r_[0 if holder is None else holder, doc[starts]][number]
        last, holder = (hi[-1], lo[-1]), first[-1]
        lost = np.flatnonzero(settled | (doc > first))
        if not len(lost):
            continue
        lists = batch.column(4).take(pa.array(lost))
        lines = lists.flatten().to_numpy()
        rows = np.repeat(lost, lists.value_lengths().to_numpy())
        order = np.lexsort((tag[rows], doc[rows]))
        d, t, lines = doc[rows][order], tag[rows][order], lines[order]
        at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        maps = [packed(lines[a:b]) for a, b in zip(at, np.r_[at[1:], len(d)])]
        yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(t[at]), pa.array(maps, pa.binary())], ["doc_id", "tag", "drops"])


def _tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): the tag tells rows with the same doc_id and other texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.crc32(text).alias("tag"))


def drop_bitmaps(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, tag, drops array of compressed bitmaps) of the documents that lose lines."""
    named = _tagged(docs).filter("doc_id IS NOT NULL")
    rows = named.mapInArrow(_keys(shortest), "hi long, lo long, doc_id long, tag long, lines array<int>, settled boolean")
    sorted_rows = rows.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo", "doc_id", "tag")
    lost = sorted_rows.mapInArrow(_losers, _DROPS)
    return lost.groupBy("doc_id", "tag").agg(F.collect_list("drops").alias("drops"))


def without_repeated_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the remaining lines as text, and n_lines, n_dropped and keep, a compressed bitmap of the lines that stay."""
    new = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])
    base = docs.select([c for c in docs.columns if c not in new.names])
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in base.schema] + new.fields)
    lost = drop_bitmaps(base, shortest).select(
        F.col("doc_id").alias("_llm_doc"), F.col("tag").alias("_llm_tag"), F.col("drops").alias("_llm_drops"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = base.withColumn("text", text).join(
        lost, (F.col("doc_id").cast("long") == F.col("_llm_doc")) & (F.crc32(text) == F.col("_llm_tag")), "left").drop("_llm_doc", "_llm_tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            texts, counts, dropped, keeps = [], [], [], []
            for text, bitmaps in zip(table.column("text").to_pylist(), table.column("_llm_drops").to_pylist()):
                lines = text.split(b"\n")
                keep = ~unpacked(bitmaps or [], len(lines))
                texts.append(text if keep.all() else b"\n".join([x for x, k in zip(lines, keep.tolist()) if k]))
                counts.append(len(lines))
                dropped.append(len(lines) - int(keep.sum()))
                keeps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            out = table.drop(["_llm_drops"])
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))
            for name, values, kind in (("n_lines", counts, pa.int64()), ("n_dropped", dropped, pa.int64()), ("keep", keeps, pa.binary())):
                out = out.append_column(name, pa.array(values, kind))
            yield from out.combine_chunks().to_batches()

    return joined.mapInArrow(run, schema)
