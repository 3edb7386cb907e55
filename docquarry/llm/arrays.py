"""Numpy helpers for Arrow batches of texts, used inside tasks.

A piece of a batch is seen as one byte array plus document offsets; words are
(start, end) positions in it and get 64-bit hashes from prefix sums, so no text
is cut into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEED = np.random.default_rng(20240501)
_BYTE_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next piece."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for x in (base, np.uint64(_inverse(base))):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            pair.append(np.multiply.accumulate(row))
        known = _POWERS[int(base)] = tuple(pair)
    return known[0][:n], known[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """The rows of all batches in tables of about ``size`` bytes of text; a longer text comes alone.

    Null texts become empty ones.
    """
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_binary()).fill_null(b"")
        batch = batch.set_column(at, column, texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(ends, ends[start] + size - total, "right")) - 1
            if stop <= start:
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, total = [], 0
                    continue
                stop = start + 1
            held.append(batch.slice(start, stop - start))
            total += int(ends[stop] - ends[start])
            start = stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column of ``pieces`` and the offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.large_binary())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(table: pa.Table, column: str = "doc_id") -> np.ndarray:
    """A long column; null becomes the smallest long, so that it has a place in every order."""
    return table.column(column).fill_null(-(1 << 63)).to_numpy()


def words_in(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the position of each document's first word (one more at the end)."""
    inside = ~separators[data]
    n = len(data)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cut] = inside[cut]
    finishes = inside
    if n:
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:]
        finishes[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    power, inverse = _powers(_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)


def window_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` words; windows may span documents, the caller leaves those out."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = _STEP + np.uint64(2 * salt)
    power, inverse = _powers(base, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * power, out=sums[1:])
    return mix((sums[length:] - sums[:count]) * inverse[:count] + np.uint64(length))


def document_of(first: np.ndarray) -> np.ndarray:
    """The document number of every word, from the positions of the documents' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_windows(first: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` words that lie in one document."""
    starts = np.diff(first) - length + 1
    starts = np.maximum(starts, 0)
    total = int(starts.sum())
    begun = np.cumsum(starts) - starts
    return np.repeat(first[:-1] - begun, starts) + np.arange(total)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, ``length`` numbers each."""
    total = int(lengths.sum())
    begun = np.cumsum(lengths) - lengths
    return np.repeat(starts - begun, lengths) + np.arange(total)


def blobs(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of values[bounds[i]:bounds[i + 1]] for every i."""
    raw, width = values.tobytes(), values.itemsize
    cuts = (bounds * width).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]
