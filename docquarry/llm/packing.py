"""Best-fit packing of documents into sequences by large-item matching.

Documents become ids plus an end id; one longer than the capacity is cut into
full pieces, the first of which may be shorter. Only piece lengths decide the
packing, so the plan is made from a histogram with one count per length:

* pieces above one third of the capacity, of which two at most fit in a
  sequence, are matched greedily: the largest with the largest that fits;
* smaller pieces, largest first, go into the smallest gap that takes them;
  what finds no gap opens sequences of its own.

The plan is a list of patterns (lengths in one sequence, how many sequences).
Pieces get their place from their rank among pieces of the same length: each
task numbers its own, and counts per task and length give the first number.
Nothing but the histogram (at most ``capacity`` rows) reaches the driver.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed each; a null doc_id is kept; an empty table gives no
rows; columns other than doc_id and text are ignored. Strings that look like
special tokens are ordinary text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.arrays import pieces
from docquarry.llm.tables import doc_columns, kept
from docquarry.llm.tokens import encoder, vocabulary_folder

CAPACITY, END = 1024, 2


class Plan:
    """Patterns of piece lengths with the number of sequences that follow each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.rest = {size: n for size, n in counts.items() if n}
        self.gaps: dict[int, list[list]] = defaultdict(list)  # gap -> [pattern, sequences]
        self.known: list[int] = []  # gaps in use, sorted
        self._match_large()
        self._fill_gaps()
        self.patterns = [tuple(p) for group in self.gaps.values() for p in group]

    def _add(self, pattern: tuple[int, ...], sequences: int) -> None:
        gap = self.capacity - sum(pattern)
        if not self.gaps[gap]:
            insort(self.known, gap)
        self.gaps[gap].append([pattern, sequences])

    def _match_large(self) -> None:
        large = sorted(size for size in self.rest if 3 * size > self.capacity)
        while large:
            size = large[-1]
            count = self.rest[size]
            at = bisect_left(large, self.capacity - size + 1) - 1
            if at < 0:
                self._add((size,), count)
                used, other = count, None
            else:
                other = large[at]
                used = count // 2 if other == size else min(count, self.rest[other])
                if used:
                    self._add((size, other), used)
                elif at:  # one is left of this length: its partner is the next smaller one
                    other = large[at - 1]
                    used = 1
                    self._add((size, other), 1)
                else:
                    self._add((size,), 1)
                    used, other = 1, None
            for spent in (size, other):
                if spent is not None:
                    self.rest[spent] -= used
                    if not self.rest[spent]:
                        large.remove(spent)
                        del self.rest[spent]
                        if spent == other:
                            other = None

    def _fill_gaps(self) -> None:
        for size in sorted(self.rest, reverse=True):
            left = self.rest[size]
            while left:
                at = bisect_left(self.known, size)
                if at == len(self.known):
                    each = min(self.capacity // size, left)
                    self._add((size,) * each, left // each)
                    left -= each * (left // each)
                    continue
                gap = self.known[at]
                group = self.gaps[gap]
                pattern, sequences = group[-1]
                # as many as the gap takes when there are enough, so that equal pieces stay together
                each = min(gap // size, left)
                taken = min(sequences, left // each)
                if taken == sequences:
                    group.pop()
                    if not group:
                        self.known.pop(at)
                        del self.gaps[gap]
                else:
                    group[-1][1] -= taken
                self._add(pattern + (size,) * each, taken)
                left -= each * taken

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> dict[str, np.ndarray]:
        """Runs of equal places: pieces numbered ``first`` and on (over all lengths, shortest first)
        go to sequences ``base`` and on, at ``offset``."""
        rows, base = [], 0
        for pattern, sequences in self.patterns:
            offset = 0
            for size in pattern:
                rows.append((size, base, offset, sequences))
                offset += size
            base += sequences
        rows.sort()
        size, base, offset, n = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        return {"first": np.cumsum(n) - n, "base": base, "offset": offset, "size": size}


def _cut(folder: str, capacity: int, end: int, with_ids: bool):
    """Encode whole texts and cut them; number the pieces of each length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for table in pieces(batches):
            ids, offsets = encode(table.column("text").to_pylist())
            lengths = np.diff(offsets) + 1
            ends = np.cumsum(lengths)
            flat = np.full(int(ends[-1]), end, "<u4")
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = ids
            count = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            short = lengths - (count - 1) * capacity
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[row], capacity)
            begin = (ends - lengths)[row] + start
            raw = memoryview(flat).cast("B")
            spans = [raw[4 * a : 4 * (a + b)] for a, b in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            runs = length[order]
            first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(runs)]))
            nth += seen[length]
            np.add.at(seen, length, 1)
            columns = [
                table.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(length), pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns.append(pa.array([bytes(s) for s in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    ``folder`` holds the vocabulary files (default: the installed public ones); ``ids`` are little-endian unsigned 32-bit values.
    """
    folder = folder or vocabulary_folder()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    cut = kept(doc_columns(docs).mapInArrow(_cut(folder, capacity, end, with_ids), schema), "pieces")
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, capacity).slots()
    before = np.zeros(capacity + 2, np.int64)
    for size, n in histogram.items():
        before[size + 1] = n
    before = np.cumsum(before)
    shared = docs.sparkSession.sparkContext.broadcast((plan["first"], plan["base"], plan["offset"], before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, offset, before = shared.value
        for batch in batches:
            length, nth, ahead = (batch.column(c).to_numpy() for c in ("length", "nth", "ahead"))
            number = before[length] + ahead + nth
            slot = np.searchsorted(first, number, "right") - 1
            keep = [n for n in batch.schema.names if n not in ("part", "nth", "ahead")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep] + [pa.array(base[slot] + number - first[slot]), pa.array(offset[slot])],
                keep + ["sequence_id", "offset"])

    # the pieces of equal length that earlier tasks made: one row per task and length
    order = Window.partitionBy("length").orderBy("part")
    ahead = counts.withColumn("ahead", F.sum("n").over(order) - F.col("n")).select("part", "length", "ahead")
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return cut.join(ahead, ["part", "length"]).select(*cut.columns, "ahead").mapInArrow(place, placed)
