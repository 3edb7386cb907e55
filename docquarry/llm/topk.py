"""Exact top-k by inner product: columnar branch and bound.

Vectors are kept in blocks in vertical layout (after BOND, de Vries et al., 2002): one
contiguous column per dimension, dimensions with the most energy in the block first, and for each
group of dimensions what is left of every vector's norm behind it. A
query takes a block by groups of dimensions: scores of all candidates grow by
the group, what is missing lies within the product of the two remaining norms, and candidates whose upper
bound is under the k-th best lower bound so far leave; those that stay are compacted.

Blocks and queries meet in a grid: query groups of bounded bytes, block groups of bounded
bytes, one task per cell, so that no task and no broadcast grows with the data;
each cell sends its k best per query. Rows are dealt to blocks by row number, so copies do not meet
in one place.

Defined results: vectors that are null or empty, or hold null, NaN or infinite components,
take no part; vectors are compared with those of their own length; a null vec_id asks
nothing and, as a candidate, comes last among equal scores; of rows with one vec_id each is a candidate and a query of its own, and
only the query's own row is left out; an empty table gives no rows; other columns are ignored. A score has to fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.tables import kept

TOP, SCALE, EVERY = 5, 256, 50
BLOCK_ROWS = 8192
GROUP_DIMENSIONS = 16
AT_ONCE = 256  # queries whose scores with a block are held at a time
CELL_BYTES = 32 << 20  # of blocks, and of queries, in one cell
NO_ID = (1 << 63) - 1  # sorts a null vec_id last

_BLOCKS = "width int, block long, rows binary, ids binary, has_id binary, dims binary, places binary"
_ASKED = "width int, row long, query_id long, vector binary"
_FOUND = "row long, query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, vector array<long>): usable vectors with floor(scale * x) for every component x."""
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    numbers = F.transform(x.cast("array<double>"), lambda v: F.floor(v * scale))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.monotonically_increasing_id().alias("row"))
    return rows.filter(F.coalesce(usable, F.lit(False))).select("row", "vec_id", numbers.alias("vector"))


def _packed(table: pa.Table) -> pa.Table:
    """One block: the group's vectors as columns, the dimensions with the most energy first, in the least whole number type."""
    width = table.column("width")[0].as_py()
    values = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    ids = table.column("vec_id")
    places = np.argsort(-np.square(values.astype(np.float64)).sum(axis=0), kind="stable").astype(np.int32)
    columns = np.ascontiguousarray(values[:, places].T)
    most = int(max(columns.max(), -1 - columns.min()))  # -1 - x, as the smallest long has no opposite
    columns = columns.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))
    blobs = [table.column("row").to_numpy().tobytes(), ids.fill_null(NO_ID).to_numpy().tobytes(),
             ids.is_valid().to_numpy().astype(np.uint8).tobytes(), columns.tobytes(), places.tobytes()]
    return pa.table([pa.array([width], pa.int32()), table.column("block")[:1], *(pa.array([b], pa.binary()) for b in blobs)],
                    names=["width", "block", "rows", "ids", "has_id", "dims", "places"])


def vertical_blocks(numbers: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of about ``block_rows`` vectors of one length, dealt by row number, in vertical layout."""
    blocks = max(1, -(-numbers.count() // block_rows))
    dealt = numbers.withColumn("width", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return kept(dealt.groupBy("width", "block").applyInArrow(_packed, _BLOCKS), "vertical")


class _Block:
    """One block's columns, ready for searching."""

    def __init__(self, width: int, rows: bytes, ids: bytes, has_id: bytes, dims: bytes, places: bytes):
        self.rows, self.ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        self.has_id = np.frombuffer(has_id, np.uint8).astype(bool)
        self.places = np.frombuffer(places, np.int32)
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(dims) // (width * len(self.rows))]
        self.dims = np.frombuffer(dims, kind).reshape(width, -1)

    def ready(self, step: int) -> None:
        """Remaining norms behind every group of dimensions, and columns that numpy multiplies fast and exactly."""
        self.edges = list(range(0, len(self.places), step)) + [len(self.places)]
        wide = self.dims.astype(np.float64)
        squares = np.square(wide)
        energy = np.stack([squares[a:b].sum(axis=0) for a, b in zip(self.edges, self.edges[1:])] + [np.zeros(len(self.rows))])
        self.left = np.sqrt(energy[::-1].cumsum(axis=0)[::-1])  # left[g]: norm of groups g, g + 1, ...
        self.longest = float(self.left[0].max())
        self.wide = wide


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = [batch.column(name)[at].as_py() for name in ("width", "rows", "ids", "has_id", "dims", "places")]
            yield row[0], _Block(*row)


def _queries(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, block in _unpacked(batches):
            asked = np.flatnonzero(block.has_id & (block.ids % every == 0))
            vectors = np.empty((len(asked), width), np.int64)
            vectors[:, block.places] = block.dims[:, asked].T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(asked), width, np.int32)), pa.array(block.rows[asked]), pa.array(block.ids[asked]),
                 pa.array([v.tobytes() for v in vectors], pa.binary())], ["width", "row", "query_id", "vector"])

    return run


def search(block: _Block, queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, candidates, scores) that may be among the k best; ``bounds`` holds each query's k-th best score so far and rises.

    ``own`` is the row of each query, which is no candidate of its own.
    """
    asked = queries[:, block.places]
    norms = np.sqrt(np.square(asked.astype(np.float64)).sum(axis=1))
    exact = block.longest * float(norms.max(initial=0.0)) < 2.0**52  # partial sums then are whole numbers in doubles
    columns = block.wide if exact else block.dims.astype(np.int64)
    asked = asked.astype(np.float64) if exact else asked
    edges, left = block.edges, block.left
    tails = [np.sqrt(np.square(asked[:, a:].astype(np.float64)).sum(axis=1)) for a in edges]
    opening = asked[:, : edges[1]] @ columns[: edges[1]]
    mine = np.full(len(queries), -1)
    order = np.argsort(block.rows)
    at = np.minimum(np.searchsorted(block.rows, own, sorter=order), len(order) - 1)
    here = block.rows[order[at]] == own
    mine[here] = order[at][here]
    for number in range(len(queries)):
        scores = opening[number]
        candidates = None
        for group in range(1, len(edges)):
            if group > 1:
                scores = scores + asked[number, edges[group - 1] : edges[group]] @ (
                    columns[edges[group - 1] : edges[group]] if candidates is None else columns[edges[group - 1] : edges[group]][:, candidates])
            missing = (left[group] if candidates is None else left[group][candidates]) * tails[group][number]
            missing = missing * (1 + 1e-9) + 1e-6 if group < len(edges) - 1 else 0  # norms are rounded, so the bounds give way a little
            if candidates is None and mine[number] >= 0:
                candidates = np.delete(np.arange(len(block.rows)), mine[number])
                scores = scores[candidates]
                missing = missing if np.isscalar(missing) else missing[candidates]
            if len(scores) > k:
                low = scores - missing
                bounds[number] = max(bounds[number], float(np.partition(low, len(low) - k)[len(low) - k]))
            stays = np.flatnonzero(scores + missing >= bounds[number])
            if len(stays) < len(scores):
                candidates = stays if candidates is None else candidates[stays]
                scores = scores[stays]
            if not len(scores):
                break
        if len(scores):
            yield number, np.arange(len(block.rows)) if candidates is None else candidates, scores.astype(np.int64)


def _cell(k: int, step: int):
    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=["row", "query_id", "vec_id", "score"])
        rows, ids = asked.column("row").to_numpy(), asked.column("query_id").to_numpy()
        queries = np.frombuffer(b"".join(asked.column("vector").to_pylist()), np.int64).reshape(len(rows), -1)
        bounds = np.full(len(rows), -np.inf)
        best: list[list[tuple[int, int, bool]]] = [[] for _ in rows]
        for _, block in _unpacked(found.to_batches()):
            block.ready(step)
            for number, candidates, scores in chain.from_iterable(
                    ((at + n, c, x) for n, c, x in search(block, queries[at : at + AT_ONCE], rows[at : at + AT_ONCE], bounds[at : at + AT_ONCE], k))
                    for at in range(0, len(rows), AT_ONCE)):
                better = [*best[number], *zip((-scores).tolist(), block.ids[candidates].tolist(), (~block.has_id[candidates]).tolist())]
                best[number] = sorted(better)[:k]
                if len(best[number]) == k:
                    bounds[number] = max(bounds[number], -best[number][-1][0])
        flat = [(int(rows[i]), int(ids[i]), None if no_id else vec_id, -score) for i, top in enumerate(best) for score, vec_id, no_id in top]
        return pa.table([pa.array([f[i] for f in flat], pa.int64()) for i in range(4)], names=["row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = TOP, scale: int = SCALE, every: int = EVERY, block_rows: int = BLOCK_ROWS,
          dimensions: int = GROUP_DIMENSIONS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(query_id, rank int, vec_id, score): for each row of ``vectors(vec_id, embedding)`` whose vec_id is divisible by
    ``every`` the ``k`` other rows with the highest inner products of whole numbers floor(scale * x), ties to the smaller vec_id."""
    spark = vectors.sparkSession
    blocks = vertical_blocks(whole_numbers(vectors, scale), block_rows)
    asked = kept(blocks.mapInArrow(_queries(every), _ASKED), "asked")
    bytes_of = asked.agg(F.sum(F.length("vector"))).first()[0] or 0
    block_bytes, n_blocks = blocks.agg(F.sum(F.length("dims")), F.count("*")).first()
    down = max(1, -(-bytes_of // cell_bytes))
    across = max(1, -(-(block_bytes or 0) // cell_bytes), min(n_blocks, spark.sparkContext.defaultParallelism))

    def every_one(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    queries = asked.withColumn("down", F.pmod(F.xxhash64("row"), F.lit(down)).cast("int")).withColumn("across", every_one(across))
    columns = blocks.withColumn("across", F.pmod(F.col("block"), F.lit(across)).cast("int")).withColumn("down", every_one(down))
    cell = ["width", "down", "across"]
    found = queries.groupBy(*cell).cogroup(columns.groupBy(*cell)).applyInArrow(lambda a, b: _cell(k, dimensions)(a, b), _FOUND)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
