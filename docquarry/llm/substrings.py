"""Removal of word runs that an earlier document holds, by level-wise doubling.

Windows are judged level by level: of the short windows only those that repeat
in another document are extended to about twice the length (two of them that
overlap or touch), up to the wanted ``length``; most texts leave at the first
level. For 13 words the levels are 7 and 13.

At the first level only the window with the smallest hash within each window of
the next level is looked at. It depends on those words alone, so equal windows
choose equally and no repeat is lost, while a quarter of the rows are sent.

Hashes travel as binary columns, one row per piece of text and bucket, and each
piece sends a hash once, for its smallest document: a passage found everywhere
costs a row entry per piece, not per document. Documents meet what was found
about them in groups of about a thousand; their texts are shuffled once, for all
levels and for the removal.

Defined results: null texts have no words; rows without a doc_id stay and are
no source of repeats; rows with the same doc_id are one document; an empty table
gives no rows; columns other than doc_id and text are ignored. Windows are
compared by 64-bit hashes at each level and 32 bits more at the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrays import document_of, ids_of, mix, pieces, text_bytes, whole_windows, window_hashes, word_hashes, words_in
from docquarry.llm.tables import doc_columns, groups_for

LENGTH = 13
SHORTEST_LEVEL = 5
_PRIME, _FACTOR = 2147483647, 1103515245
_ROWS = "bucket int, settled boolean, hashes binary, checks binary, docs binary, flags binary"
_ROW_NAMES = ["bucket", "settled", "hashes", "checks", "docs", "flags"]
_ROW_TYPES = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NO_ID = -(1 << 63)


def levels(length: int) -> list[int]:
    """Window lengths from the first level to ``length``, each at most twice the one before."""
    found = [length]
    while (found[0] + 1) // 2 >= SHORTEST_LEVEL:
        found.insert(0, (found[0] + 1) // 2)
    return found


def home_column(groups: int) -> Column:
    """The group of a document; rows without an id are spread by their text."""
    known = F.shiftright(F.expr(f"pmod(doc_id, {_PRIME}L)") * F.lit(_FACTOR).cast("long"), 16)
    return F.pmod(F.coalesce(known, F.abs(F.hash("text")).cast("long")), F.lit(groups).cast("long")).cast("int")


def home_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (((ids % _PRIME) * _FACTOR >> 16) % groups).astype(np.int32)


def pack_ids(ids: np.ndarray) -> bytes:
    """Longs by byte planes, which compress well when they are near each other."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _by_bucket(bucket: np.ndarray, settled: bool, hashes: np.ndarray, checks: np.ndarray | None, docs: np.ndarray, flags: np.ndarray | None) -> list[tuple]:
    """Rows of ``_ROWS``, one per bucket; ``bucket`` is sorted."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    return [
        (int(bucket[a]), settled, hashes[a:b].tobytes(), b"" if checks is None else checks[a:b].tobytes(), pack_ids(docs[a:b]),
         b"" if flags is None else np.packbits(flags[a:b]).tobytes())
        for a, b in zip(at, np.r_[at[1:], len(bucket)])
    ]


def _settle(hashes: np.ndarray, checks: np.ndarray | None, docs: np.ndarray, groups: int, last: bool) -> list[tuple]:
    """What one piece sends: each hash with its smallest document, and what is known already about the others."""
    order = np.lexsort((docs, hashes)) if checks is None else np.lexsort((docs, checks, hashes))
    hashes, docs = hashes[order], docs[order]
    checks = None if checks is None else checks[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    if checks is not None:
        new |= np.r_[True, checks[1:] != checks[:-1]]
    at = np.flatnonzero(new)
    fresh = new | np.r_[True, docs[1:] != docs[:-1]]
    number = np.cumsum(new) - 1
    shared = np.maximum.reduceat(docs, at) != docs[at]
    known = fresh & ~new if last else fresh & shared[number]
    bucket = (hashes[at] % np.uint64(groups)).astype(np.int32)
    turn = np.argsort(bucket, kind="stable")
    rows = _by_bucket(bucket[turn], False, hashes[at][turn], None if checks is None else checks[at][turn], docs[at][turn], shared[turn])
    if known.any():
        home = home_of(docs[known], groups)
        turn = np.argsort(home, kind="stable")
        rows += _by_bucket(home[turn], True, hashes[known][turn], None, docs[known][turn], None)
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ROW_TYPES)], _ROW_NAMES)


class _Piece:
    """Word hashes of one piece of documents; rows without an id have no windows."""

    def __init__(self, table: pa.Table):
        data, offsets = text_bytes(table.column("text"))
        self.ids = ids_of(table)
        starts, ends, self.first = words_in(data, offsets)
        self.words = word_hashes(data, starts, ends)
        self.doc = self.ids[document_of(self.first)]

    def starts(self, length: int) -> np.ndarray:
        at = whole_windows(self.first, length)
        return at[self.doc[at] != _NO_ID] if (self.ids == _NO_ID).any() else at

    def anchors(self, base: int, length: int) -> np.ndarray:
        """For every window of ``length`` words the smallest hash of its windows of ``base`` words."""
        found = window_hashes(self.words, base)
        least, span, wanted = found, 1, length - base + 1
        while span < wanted:
            step = min(span, wanted - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        return least


def _first_level(lengths: list[int], groups: int):
    base, after = lengths[0], lengths[min(1, len(lengths) - 1)]
    last = len(lengths) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            piece = _Piece(table)
            at = piece.starts(after)
            if not len(at):
                continue
            hashes, docs = piece.anchors(base, after)[at], piece.doc[at]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])]
            at, hashes, docs = at[new], hashes[new], docs[new]
            checks = window_hashes(piece.words, base, 7)[at].astype(np.uint32) if last else None
            yield _batch(_settle(mix(hashes) if not last else hashes, checks, docs, groups, last))

    return run


def _member(hashes: np.ndarray, docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (hash, document) are among the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(hashes), bool)
    asked = _keys(hashes, docs)
    return keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked


def _keys(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(docs.astype(np.int64).view(np.uint64)))


def _found(table: pa.Table) -> np.ndarray:
    """Sorted keys of the (hash, document) pairs that came back to a group."""
    parts = [
        _keys(np.frombuffer(h, np.uint64), unpack_ids(d))
        for h, d in zip(table.column("hashes").to_pylist(), table.column("docs").to_pylist())
    ]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _next_level(lengths: list[int], level: int, groups: int):
    before, length, last = lengths[level - 1], lengths[level], level == len(lengths) - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, rows = _found(right), []
        for table in pieces(left.to_batches()) if len(keys) else ():
            piece = _Piece(table)
            at = piece.starts(length)
            if not len(at):
                continue
            docs = piece.doc[at]
            if level == 1:
                repeated = _member(mix(piece.anchors(before, length)[at]), docs, keys)
            else:
                halves = window_hashes(piece.words, before)
                repeated = _member(halves[at], docs, keys) & _member(halves[at + length - before], docs, keys)
            at, docs = at[repeated], docs[repeated]
            if len(at):
                checks = window_hashes(piece.words, length, 7)[at].astype(np.uint32) if last else None
                rows += _settle(window_hashes(piece.words, length)[at], checks, docs, groups, last)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _reduce(groups: int, last: bool):
    """Find the hashes that several documents sent, and tell each of those documents."""

    def run(table: pa.Table) -> pa.Table:
        settled = table.filter(table.column("settled"))
        sent = table.filter(pa.compute.invert(table.column("settled")))
        rows = [(h, True, a, b"", d, b"") for h, a, d in zip(*(settled.column(c).to_pylist() for c in ("bucket", "hashes", "docs")))]
        if sent.num_rows:
            hashes = [np.frombuffer(x, np.uint64) for x in sent.column("hashes").to_pylist()]
            docs = np.concatenate([unpack_ids(x) for x in sent.column("docs").to_pylist()])
            flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(h)] for x, h in zip(sent.column("flags").to_pylist(), hashes)])
            hashes = np.concatenate(hashes)
            if last:
                checks = np.concatenate([np.frombuffer(x, np.uint32) for x in sent.column("checks").to_pylist()])
                order = np.lexsort((checks, hashes))
                checks = checks[order]
            else:
                order = np.argsort(hashes, kind="stable")
            hashes, docs, flags = hashes[order], docs[order], flags[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]]
            if last:
                new |= np.r_[True, checks[1:] != checks[:-1]]
            at, number = np.flatnonzero(new), np.cumsum(new) - 1
            least, most = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
            if last:
                told = docs > least[number]
            else:
                told = ((most != least) | np.maximum.reduceat(flags, at).astype(bool))[number] & (flags == 0)
            home = home_of(docs[told], groups)
            turn = np.argsort(home, kind="stable")
            rows += _by_bucket(home[turn], True, hashes[told][turn], None, docs[told][turn], None)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _remove(length: int):
    names = ["doc_id", "n_words", "n_removed", "text"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, out = _found(right), []
        for table in pieces(left.to_batches()):
            lost = None
            if len(keys):
                piece = _Piece(table)
                at = piece.starts(length)
                at = at[_member(window_hashes(piece.words, length)[at], piece.doc[at], keys)] if len(at) else at
                edges = np.zeros(len(piece.words) + 1, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + length, -1)
                lost = np.cumsum(edges[:-1]) > 0
            counts, removed, texts, begun = [], [], [], 0
            for text in table.column("text").to_pylist():
                words = text.split()
                counts.append(len(words))
                own = lost[begun : begun + len(words)] if lost is not None else None
                begun += len(words)
                gone = int(own.sum()) if own is not None else 0
                removed.append(gone)
                texts.append(b" ".join([w for w, x in zip(words, own.tolist()) if not x] if gone else words))
            out.append(pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.binary()).cast(pa.string())], names))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
        return pa.Table.from_batches(out, schema)

    return run


def without_repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, text): text has the kept words, joined by one space.

    A word goes if a window of ``length`` words over it also starts in a document with a smaller doc_id.
    """
    if length < 1:
        raise ValueError("length must be positive")
    lengths = levels(length)
    groups = groups_for(docs)
    texts = doc_columns(docs)
    placed = texts.select(home_column(groups).alias("bucket"), "doc_id", "text")
    rows = texts.mapInArrow(_first_level(lengths, groups), _ROWS)
    found = rows.groupBy("bucket").applyInArrow(_reduce(groups, len(lengths) == 1), _ROWS)
    for level in range(1, len(lengths)):
        rows = placed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_next_level(lengths, level, groups), _ROWS)
        found = rows.groupBy("bucket").applyInArrow(_reduce(groups, level == len(lengths) - 1), _ROWS)
    return placed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(
        _remove(length), "doc_id long, n_words long, n_removed long, text string")
