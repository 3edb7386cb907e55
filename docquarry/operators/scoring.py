"""The block scorer: exact cosine of a batch of chunks against a block of queries.

Runs inside ``mapInArrow`` tasks. A task keeps at most ``k`` candidates per
query, so what leaves it does not grow with the chunks it read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docquarry.functions.vectors import SCORE_DIGITS
from docquarry.sources.shared import SharedParts

BUFFER_BYTES = 128 << 20  # of chunk batches a task holds while it reads blocks of queries
SLICE_BYTES = 4 << 20  # of chunk rows scored at once
SCORES_AT_ONCE = 4_000_000  # entries of one score matrix (32 MB)
ROUNDING_MARGIN = 1.5 * 10.0**-SCORE_DIGITS


@dataclass
class QueryBlock:
    """A bounded set of queries, as used by one task."""

    ids: pa.ChunkedArray
    unit: np.ndarray
    open_rows: np.ndarray
    scoped_rows: dict

    @staticmethod
    def from_table(table: pa.Table) -> "QueryBlock":
        if pc.count_distinct(table.column("query_id")).as_py() < len(table):
            raise ValueError("query ids must be unique")
        unit, usable = unit_rows(table.column("embedding"))
        table = table.take(pa.array(usable))
        scopes = table.column("scope").to_pylist()
        scoped: dict = {}
        open_rows = []
        for row, scope in enumerate(scopes):
            if scope is None:
                open_rows.append(row)
            else:
                scoped.setdefault(scope, []).append(row)
        return QueryBlock(
            ids=table.column("query_id"),
            unit=unit,
            open_rows=np.array(open_rows, dtype=np.int64),
            scoped_rows={scope: np.array(rows, dtype=np.int64) for scope, rows in scoped.items()},
        )


def unit_rows(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Float64 rows of length 1, and the positions they came from.

    Null and all-zero vectors have no cosine and are left out.
    """
    column = vectors.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    present = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(present))
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) == 0:
        return np.zeros((0, 0)), present
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(sizes.tolist()))}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(sizes), sizes[0])
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    usable = np.flatnonzero(lengths > 0)
    return rows[usable] / lengths[usable, None], present[usable]


def best_of(
    scores: np.ndarray, k: int | None, tie_rank: np.ndarray, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk, rounded score) of each row's k best scores; equal scores
    go to the chunk of lower ``tie_rank``. Scores below ``floor``, what each
    query already has k of, may be left out.

    Only candidates are rounded: whatever rounds to the k-th score or above
    lies within the margin of it.
    """
    if k is None or scores.shape[1] <= k:
        asked, chunks = (axis.ravel() for axis in np.indices(scores.shape))
    else:
        least = floor
        if np.isneginf(floor).any():
            at = scores.shape[1] - k
            least = np.maximum(floor, np.partition(scores, at, axis=1)[:, at])
        asked, chunks = np.nonzero(scores >= (least - ROUNDING_MARGIN)[:, None])
    rounded = np.round(scores[asked, chunks], SCORE_DIGITS) + 0.0
    if k is None:
        return asked, chunks, rounded
    order = np.lexsort((tie_rank[chunks], -rounded, asked))
    order = order[place_in_run(asked[order]) < k]
    return asked[order], chunks[order], rounded[order]


def place_in_run(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal neighbours."""
    at = np.arange(len(groups))
    starts = np.r_[True, groups[1:] != groups[:-1]][: len(groups)]
    return at - np.maximum.accumulate(np.where(starts, at, 0)) if len(groups) else at


def in_slices(batches: Iterator[pa.RecordBatch], slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``slice_bytes``: scoring takes several times the space of the vectors it is given."""
    for batch in batches:
        rows = max(1, slice_bytes * batch.num_rows // max(batch.nbytes, 1))
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


class BlockScorer:
    """Iterator of chunk batches to iterator of candidate batches."""

    def __init__(self, block, k: int | None, per_document: bool, ties: list[tuple[str, str]]):
        self.block = block  # a Spark broadcast of the queries' Arrow table
        self.k = k
        self.per_document = per_document
        self.ties = ties

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = QueryBlock.from_table(self.block.value)
        running = self.k is not None and not self.per_document
        room = 8 * (self.k or 1) * max(len(queries.unit), 1)
        held: list[pa.Table] = []
        held_rows = 0
        floor = np.full(len(queries.unit), -np.inf)
        for batch in in_slices(batches):
            found = self.candidates(queries, pa.Table.from_batches([batch]), floor)
            if not running:
                yield from self.finish(queries, found)
                continue
            held.append(found)
            held_rows += len(found)
            if held_rows > room or len(held) == 1:
                held = [self.cut(pa.concat_tables(held))]
                held_rows = len(held[0])
                self.raise_floor(floor, held[0])
        if held:
            yield from self.finish(queries, self.cut(pa.concat_tables(held)))

    def raise_floor(self, floor: np.ndarray, kept: pa.Table) -> None:
        """Set the k-th score of every query that has k candidates."""
        asked, scores = kept.column("_query").to_numpy(), kept.column("score").to_numpy()
        last = place_in_run(asked) == self.k - 1
        floor[asked[last]] = scores[last]

    def candidates(self, queries: QueryBlock, chunks: pa.Table, floor: np.ndarray) -> pa.Table:
        if chunks.column("doc_id").null_count or chunks.column("chunk_index").null_count:
            raise ValueError("a chunk without an id")
        unit, usable = unit_rows(chunks.column("embedding"))
        chunks = chunks.drop_columns(["embedding"]).take(pa.array(usable))
        tie_rank = np.empty(len(chunks), dtype=np.int64)
        tie_rank[pc.sort_indices(chunks, self.ties).to_numpy()] = np.arange(len(chunks))
        found_rows, found_queries, found_scores = [], [], []
        for rows, asked in self.groups(queries, chunks):
            vectors = unit if rows is None else unit[rows]
            ranks = tie_rank if rows is None else tie_rank[rows]
            width = max(1, SCORES_AT_ONCE // max(len(vectors), 1))
            for at in range(0, len(asked), width):
                some = asked[at : at + width]
                which, picked, scores = best_of(queries.unit[some] @ vectors.T, self.k, ranks, floor[some])
                found_rows.append(picked if rows is None else rows[picked])
                found_queries.append(some[which])
                found_scores.append(scores)
        rows = np.concatenate(found_rows) if found_rows else np.zeros(0, dtype=np.int64)
        asked = np.concatenate(found_queries) if found_queries else np.zeros(0, dtype=np.int64)
        scores = np.concatenate(found_scores) if found_scores else np.zeros(0)
        return (
            chunks.take(pa.array(rows))
            .append_column("_query", pa.array(asked))
            .append_column("score", pa.array(scores))
        )

    def groups(self, queries: QueryBlock, chunks: pa.Table):
        """(chunk rows, query rows) blocks to multiply; None stands for all rows."""
        if len(chunks) == 0:
            return
        if not self.per_document and len(queries.open_rows):
            yield None, queries.open_rows
        if not self.per_document and not queries.scoped_rows:
            return
        coded = chunks.column("doc_id").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.unify_dictionaries().combine_chunks()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        for rows in np.split(order, cuts):
            asked = queries.scoped_rows.get(coded.dictionary[codes[rows[0]]].as_py())
            if self.per_document and len(queries.open_rows):
                yield rows, queries.open_rows
            if asked is not None:
                yield rows, asked

    def cut(self, found: pa.Table) -> pa.Table:
        found = found.sort_by([("_query", "ascending"), ("score", "descending"), *self.ties])
        place = place_in_run(found.column("_query").to_numpy())
        return found.take(pa.array(np.flatnonzero(place < self.k)))

    def finish(self, queries: QueryBlock, found: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = queries.ids.take(found.column("_query"))
        named = found.drop_columns(["_query"]).add_column(0, "query_id", ids)
        yield from named.combine_chunks().to_batches(max_chunksize=10_000)


@dataclass
class Held:
    """A block of queries in the task's own memory, in place of a broadcast."""

    value: pa.Table


class SharedBlockScorer:
    """Many blocks of queries in one pass over the chunks.

    A task holds a buffer of chunk batches and scores it with one block after the other, each read
    from the shared folder; candidates leave per buffer and block.
    """

    def __init__(self, blocks: SharedParts, k: int | None, per_document: bool, ties: list[tuple[str, str]], buffer_bytes: int = BUFFER_BYTES):
        self.blocks, self.k, self.per_document, self.ties, self.buffer_bytes = blocks, k, per_document, ties, buffer_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= self.buffer_bytes:
                yield from self.scored(held)
                held, size = [], 0
        if held:
            yield from self.scored(held)

    def scored(self, chunks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in sorted(self.blocks.files):
            scorer = BlockScorer(Held(self.blocks.part(number)), self.k, self.per_document, self.ties)
            yield from scorer(iter(chunks))
