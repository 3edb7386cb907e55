"""Token counts of the fields or sections of documents, from one encoding of the whole text.

A text is encoded once; each token has a span of characters. Sections are spans
of the same text. Both lists are sorted, so they are joined by a merge within the
task that encoded the text: a token belongs to the sections it overlaps, and one
that crosses a boundary is allocated by a rule:

* ``start``: to the section that holds its first character,
* ``end``: to the one that holds its last character,
* ``most``: to the one with most of its characters, the first of equals.

So the counts of adjoining sections add up to the tokens of the text.

Sections come as a column of (section, start, end) structs, in characters, the
end not included, or are the lines of the text. They may leave gaps, whose
tokens count under no section, but must not overlap. A span that crosses another or
is not within the text is an error in the data: it is cut at the end of the text
and at the next span's start.

Defined results: a null or empty text has no tokens, and as lines one empty line;
null or empty section lists give no rows; a character of several tokens lies in
the span of each; a null doc_id and repeated rows are kept; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrays import pieces, text_bytes
from docquarry.llm.tables import doc_columns
from docquarry.llm.tokens import Encoder, encoder, vocabulary_folder

RULES = ("start", "end", "most")


def token_spans(texts: list[bytes], data: np.ndarray, offsets: np.ndarray, encode: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last character of every token, counted over the whole piece; the
    offsets of each text's tokens, and of each text's characters."""
    ids, cuts = encode.encode(texts)
    ends = np.cumsum(encode.id_bytes[ids])
    starts = ends - encode.id_bytes[ids]
    leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters begun before each byte
    return leads[starts + 1] - 1, leads[ends], cuts, leads[offsets]


def _lines(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line spans of all texts, each with its line feed: owner, start, end."""
    leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    feeds = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, feeds, "right") - 1
    n = len(offsets) - 1
    who = np.r_[owner, np.arange(n)]
    stop = np.r_[leads[feeds + 1], chars[1:]]
    order = np.lexsort((np.r_[np.zeros(len(feeds)), np.ones(n)], stop, who))
    who, stop = who[order], stop[order]
    begin = np.r_[0, stop[:-1]]
    new = np.r_[True, who[1:] != who[:-1]]
    begin[new] = chars[who[new]]
    return who, begin, stop


def _shares(begin: np.ndarray, stop: np.ndarray, first: np.ndarray, past: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section, and those among them that cross a boundary. Spans are sorted."""
    n = len(begin)
    low = np.searchsorted(begin, first, "right") - 1  # last section that starts at or before the token
    high = np.searchsorted(begin, past - 1, "right") - 1
    at = {"start": low, "end": high}.get(rule)
    if at is None:
        # only a crossing token has a choice, and a token of three characters or more may span several sections
        at = low.copy()
        for i in np.flatnonzero(low != high).tolist():
            options = np.arange(max(low[i], 0), high[i] + 1)
            held = np.minimum(stop[options], past[i]) - np.maximum(begin[options], first[i])
            at[i] = options[int(np.argmax(held))]
    point = {"start": first, "end": past - 1}.get(rule)
    inside = at >= 0
    own = np.maximum(at, 0)
    if point is None:
        inside &= (np.minimum(stop[own], past) > np.maximum(begin[own], first)) if n else False
    else:
        inside &= (point >= begin[own]) & (point < stop[own]) if n else False
    crosses = inside & ((first < begin[own]) | (past > stop[own])) if n else inside
    return np.bincount(at[inside], minlength=n), np.bincount(at[crosses], minlength=n)


def token_counts(docs: DataFrame, sections: Column | None = None, rule: str = "start", folder: str | None = None) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens), one row per section.

    ``sections`` is a column of ``docs``, array<struct<section string, start int, end int>>; without one
    the sections are the lines, named by their number from 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    folder = folder or vocabulary_folder()
    by_line = sections is None
    texts = doc_columns(docs) if by_line else docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        sections.cast("array<struct<section:string,start:int,end:int>>").alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder)
        for table in pieces(batches):
            data, offsets = text_bytes(table.column("text"))
            first, past, cuts, chars = token_spans(table.column("text").to_pylist(), data, offsets, encode)
            if by_line:
                who, begin, stop = _lines(data, offsets, chars)
                names = np.arange(len(who)) - np.searchsorted(who, who)
                names = pa.array(names).cast(pa.string())
            else:
                who, begin, stop, names = _given(table.column("sections").to_pylist(), chars)
            counted, crossing = _shares(begin, stop, first, past, rule)
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks().take(pa.array(who, pa.int64())), names, pa.array(begin - chars[who], pa.int64()),
                 pa.array(stop - chars[who], pa.int64()), pa.array(counted, pa.int64()), pa.array(crossing, pa.int64()), pa.array(np.diff(cuts)[who], pa.int64())],
                ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    return texts.mapInArrow(run, "doc_id long, section string, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")


def _given(lists: list[list[dict] | None], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sections given as data, sorted and cut to the text and to each other."""
    who, begin, stop, names = [], [], [], []
    for row, spans in enumerate(lists):
        size = int(chars[row + 1] - chars[row])
        spans = sorted((s for s in spans or [] if s and s["start"] is not None and s["end"] is not None), key=lambda s: (s["start"], s["end"]))
        edges = [min(max(s["start"], 0), size) for s in spans] + [size]
        for span, start, following in zip(spans, edges, edges[1:]):
            who.append(row)
            begin.append(start)
            stop.append(max(start, min(span["end"], following)))
            names.append(span["section"])
    base = chars[np.array(who, np.int64)] if who else np.zeros(0, np.int64)
    return np.array(who, np.int64), base + np.array(begin, np.int64), base + np.array(stop, np.int64), pa.array(names, pa.string())
