"""Periodic runs of words: maximal stretches that repeat with one period.

Baier grouping: phase one of Baier's suffix sorter (2016) takes groups of suffixes
from the highest down; a suffix left of a group joins a new group right above its
own, whose context is longer by the group's context, once for each of the group's
suffixes that follow it. What remains at the end is a
suffix's longest Lyndon prefix, so phase one yields the Lyndon array directly
(Franek, Paracha and Smyth, 2017). It runs under an order of the words and its
reverse: by the runs theorem (Bannai et al., 2017) every run has a period that
is a longest Lyndon prefix under one of them. Those roots are extended to both
sides through longest common extensions (prefix hashes), and what reaches the asked
length is a run, compared word by word once more.

Texts are cut first at words that are too rare nearby: in a run of exponent e each
word stands at least floor(e) times, so a word that is rarer in its stretch lies in no run and borders none.

Everything is local to a document: no shuffle, and a lost executor repeats its
partitions alone. Words are told apart by 64-bit hashes.

Defined results: null and empty texts have no runs and an empty collapsed text;
a null doc_id is kept; repeated rows are answered each; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrays import document_of, mix, pieces, text_bytes, word_hashes, words_in
from docquarry.llm.tables import doc_columns

MIN_LENGTH, MIN_EXPONENT = 6, 4
CUTS = 6  # rounds of cutting at rare words; more would only cut finer
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def lyndon_array(codes: list[int]) -> list[int]:
    """The length of the longest Lyndon word at every position of ``codes`` (whole numbers from 0)."""
    n, kinds = len(codes), max(codes, default=-1) + 1
    group = [-1, *codes, -1]  # positions count from 1, with a border on both sides
    members: list[list[int]] = [[] for _ in range(kinds)]
    for at, code in enumerate(codes, 1):
        members[code].append(at)
    context = [1] * kinds
    below, above = list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))  # suffixes not yet settled
    found = [0] * (n + 2)
    now = kinds - 1
    while now >= 0:
        length = context[now]
        raised: dict[tuple[int, int], list[int]] = {}
        for at in members[now]:
            if group[at] != now or found[at] or group[left[at]] == now:
                continue
            # a chain of suffixes of this group, all with the same suffix of a lower group before them
            count, after, before = 0, at, left[at]
            while group[after] == now:
                found[after] = length
                count += 1
                after = right[after]
            right[before], left[after] = after, before
            if before:
                raised.setdefault((count, group[before]), []).append(before)
        for count, old in sorted(raised, reverse=True):
            new = len(context)
            context.append(context[old] + count * length)
            members.append(raised[count, old])
            for at in members[new]:
                group[at] = new
            upper = above[old]
            above[old] = new
            below.append(old)
            above.append(upper)
            if upper >= 0:
                below[upper] = new
        now = below[now]
    return found[1:-1]


def _stretches(words: np.ndarray, doc: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of documents outside which no run lies."""
    at, stretch = np.arange(len(words)), doc
    for _ in range(CUTS):
        if not len(at):
            return []
        keys = mix(words[at] + stretch.astype(np.uint64) * _STEP)
        _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        kept = counts[number] >= least
        whole = bool(kept.all())
        at, stretch = at[kept], stretch[kept]
        begins = np.ones(len(at), bool)
        begins[1:] = (np.diff(at) > 1) | (np.diff(stretch) != 0)
        stretch = np.cumsum(begins) - 1
        long_enough = np.bincount(stretch, minlength=1)[stretch] >= shortest
        if whole and long_enough.all():
            break
        at, stretch = at[long_enough], stretch[long_enough]
    if not len(at):
        return []
    begins = np.ones(len(at), bool)
    begins[1:] = np.diff(stretch) != 0
    firsts = np.flatnonzero(begins)
    lasts = np.append(firsts[1:], len(at)) - 1
    return list(zip(at[firsts].tolist(), (at[lasts] + 1).tolist()))


class _Extensions:
    """Longest common extensions of words a fixed distance apart, by prefix hashes and bisection."""

    def __init__(self, words: np.ndarray):
        self.power = np.full(len(words) + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * self.power[:-1], out=self.sums[1:])

    def equal(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether words[start:end] equals the same many words ``period`` later."""
        one = self.sums[end] - self.sums[start]
        other = self.sums[end + period] - self.sums[start + period]
        return one * self.power[period] == other

    def reach(self, start: np.ndarray, period: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        """How many words from ``start`` on (sign 1) or before it (sign -1) equal those ``period`` later."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(start, start + middle, period) if sign > 0 else self.equal(start - middle, start, period)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low


def _compared(words: np.ndarray, low: int, high: int, start: int, end: int, period: int) -> tuple[int, int]:
    """The run's start and end by comparing words, should two hashes ever have been equal by chance."""
    if np.array_equal(words[start : end - period], words[start + period : end]):
        return start, end
    middle = (start + end - period) // 2
    differs = np.flatnonzero(words[low : high - period] != words[low + period : high]) + low
    place = int(np.searchsorted(differs, middle))
    return (int(differs[place - 1]) + 1 if place else low), (int(differs[place]) if place < len(differs) else high - period) + period


def runs_in(words: np.ndarray, stretches: list[tuple[int, int]], min_length: int, min_exponent: float) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs inside the stretches, by start, then period."""
    places, periods, lows, highs = [], [], [], []
    for low, high in stretches:
        kinds, codes = np.unique(words[low:high], return_inverse=True)
        for order in (codes, len(kinds) - 1 - codes):
            periods.append(np.array(lyndon_array(order.tolist()), np.int64))
            places.append(np.arange(low, high))
            lows.append(np.full(high - low, low))
            highs.append(np.full(high - low, high))
    if not periods:
        return []
    at, period, low, high = map(np.concatenate, (places, periods, lows, highs))
    extensions = _Extensions(words)

    def only(chosen: np.ndarray) -> None:
        nonlocal at, period, low, high
        at, period, low, high = at[chosen], period[chosen], low[chosen], high[chosen]

    only(np.maximum(min_length, np.ceil(min_exponent * period)) <= high - low)
    # a run goes on for half of what it needs beyond its root to one side at least
    need = np.ceil((np.maximum(min_length, np.ceil(min_exponent * period)) - period) / 2).astype(np.int64)
    to_right, to_left = at + period + need <= high, at - need >= low
    fits = np.zeros(len(at), bool)
    fits[to_right] = extensions.equal(at[to_right], (at + need)[to_right], period[to_right])
    fits[to_left] |= extensions.equal((at - need)[to_left], at[to_left], period[to_left])
    only(fits)
    start = at - extensions.reach(at, period, at - low, -1)
    end = at + period + extensions.reach(at, period, high - at - period, 1)
    enough = end - start >= np.maximum(min_length, np.ceil(min_exponent * period))
    rows = np.unique(np.stack([start, period, end, low, high], axis=1)[enough], axis=0)
    found = set()
    for start_, period_, end_, low_, high_ in rows.tolist():
        a, b = _compared(words, low_, high_, start_, end_, period_)
        if b - a >= max(min_length, min_exponent * period_):
            found.add((a, b, period_))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    parts = text.split()
    if runs:
        lost = np.zeros(len(parts), bool)
        for start, length, period in runs:
            lost[start + period : start + length] = True
        parts = [part for part, gone in zip(parts, lost.tolist()) if not gone]
    return b" ".join(parts)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, text) of every row of ``docs(doc_id, text)``.

    ``runs`` are structs (start, length, period) in words, by start and period: stretches
    of at least ``min_length`` words and ``min_exponent`` (2 or more) smallest periods that no
    neighbouring word extends. ``text`` holds the words, joined by one space, that no run repeats: a run keeps its first period.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            data, offsets = text_bytes(table.column("text"))
            starts, ends, first = words_in(data, offsets)
            words = word_hashes(data, starts, ends)
            doc = document_of(first)
            of_doc: dict[int, list[tuple[int, int, int]]] = {}
            for start, end, period in runs_in(words, _stretches(words, doc, int(min_exponent), min_length), min_length, min_exponent):
                number = int(doc[start])
                of_doc.setdefault(number, []).append((start - int(first[number]), end - start, period))
            texts = [_collapsed(text, of_doc.get(i, [])) for i, text in enumerate(table.column("text").to_pylist())]
            rows = [[dict(zip(("start", "length", "period"), r)) for r in of_doc.get(i, [])] for i in range(len(texts))]
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(rows, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "text"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of a tenth of the documents, chosen by crc32(doc_id), repeat some of their words from one word on.

    With h = crc32(doc_id as text), g = h div 10 and n words, texts with h mod 10 = 0 keep their words up to a = g mod n and repeat the next
    1 + (n - a) div (3 + g mod 8) from there on. A null doc_id or a text without words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the one-element array binds the words, so that they are taken from the text once
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return doc_columns(docs).select("doc_id", F.when(h % 10 == 0, F.coalesce(changed, "text")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document of ``find_runs``: counts, the longest run, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "text",
        best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", F.sha2("text", 256).alias("collapsed_sha256"))
