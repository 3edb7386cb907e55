"""Text shaping: line ends, trimming, file extensions and the chunk splitter.

Offsets and lengths of chunks count UTF-16 units, so a character above U+FFFF
counts twice; one that a chunk's end cuts in two is replaced by U+FFFD on both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters an ECMAScript trim() removes from both ends.
TRIM_CHARS = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Accepted upload extensions, and those that carry pages.
SUPPORTED_EXTENSIONS = (".txt", ".md", ".csv", ".pdf", ".docx")
PAGED_EXTENSIONS = (".pdf",)

# Default chunk length, overlap, and the earliest point (as a
# share of the chunk length) at which a newline may end a chunk.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
BREAK_SHARE = 0.6

TEXTS_AT_ONCE = 256  # texts a Python worker takes out of an Arrow batch


def trim_text(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty or all-whitespace text."""
    return F.coalesce(trim_text(text) == "", F.lit(True))


def normalize_text(text: Column) -> Column:
    """CRLF becomes LF (a lone CR stays), then both ends are trimmed."""
    return trim_text(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def has_supported_extension(file_name: Column) -> Column:
    lowered = F.lower(file_name)
    matches = F.lit(False)
    for extension in SUPPORTED_EXTENSIONS:
        matches = matches | lowered.endswith(extension)
    return F.coalesce(matches, F.lit(False))


def check_chunk_options(chunk_size: int, overlap: int) -> None:
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap < 0 or overlap >= chunk_size:
        raise ValueError("overlap must be at least 0 and smaller than chunk_size")


def window_spans(text: str, chunk_size: int, overlap: int):
    """Yield the [start, end) spans of one normalised text."""
    shortest = math.floor(chunk_size * BREAK_SHARE)
    length = len(text)
    start = 0
    while start < length:
        stop = start + chunk_size
        if stop >= length:
            yield start, length
            return
        # The newline may sit at `stop` itself, and must lie past the
        # shortest allowed length; searching only that range is equivalent.
        newline = text.rfind("\n", start + shortest + 1, stop + 1)
        if newline >= 0:
            stop = newline
        yield start, stop
        start = max(stop - overlap, start + 1)


def utf16_units(text: str) -> str:
    """The text with one character per UTF-16 unit."""
    if text.isascii() or max(text) <= "\uffff":
        return text
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def pieces_of(text: str | None, chunk_size: int, overlap: int) -> list[str]:
    """The chunks of one normalised text."""
    units = utf16_units(text or "")
    found = []
    for start, stop in window_spans(units, chunk_size, overlap):
        piece = units[start:stop]
        if units is not text:
            piece = piece.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        piece = piece.strip(TRIM_CHARS)
        if piece:
            found.append(piece)
    return found


def count_pieces(chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Arrow-batched UDF: how many chunks a normalised text gives; 0 for null."""
    check_chunk_options(chunk_size, overlap)

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(pieces_of(text.as_py(), chunk_size, overlap)) for text in texts], pa.int64())

    return count


def split_pieces(chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Arrow-batched UDF: normalised text to the ordered array of its chunks.

    Each step depends on where the previous chunk ended, which SQL could only
    say with an interpreted fold; see ``split_pieces_native``.
    """
    check_chunk_options(chunk_size, overlap)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        found = [pa.array([pieces_of(text, chunk_size, overlap) for text in texts.slice(at, TEXTS_AT_ONCE).to_pylist()], type=kind)
                 for at in range(0, len(texts), TEXTS_AT_ONCE)]
        return pa.concat_arrays(found) if found else pa.array([], type=kind)

    return pieces


def split_pieces_native(text: Column, chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The same pieces as a built-in expression, without Python.

    Slower than the UDF (the fold over candidate positions is interpreted), so
    it serves clusters without Python workers and as a cross-check in tests.
    Expects normalised text. Counts code points: the same up to U+FFFF.
    """
    check_chunk_options(chunk_size, overlap)
    shortest = math.floor(chunk_size * BREAK_SHARE)
    step = max(1, shortest + 1 - overlap)
    length = F.length(text)
    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(length / F.lit(step)).cast("int") + 1))
    start_state = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("found"))

    def advance(state: Column, _turn: Column) -> Column:
        start = state["start"]
        window = F.substring(text, start + 1, F.lit(chunk_size + 1))
        back = F.instr(F.reverse(window), F.lit("\n"))
        newline = start + F.lit(chunk_size + 1) - back
        full = start + F.lit(chunk_size)
        stop = (
            F.when(full >= length, length)
            .when((back > 0) & (newline > start + F.lit(shortest)), newline)
            .otherwise(full)
        )
        piece = trim_text(F.substring(text, start + 1, stop - start))
        following = F.when(stop >= length, length).otherwise(F.greatest(stop - F.lit(overlap), start + 1))
        grown = F.when(piece == "", state["found"]).otherwise(F.concat(state["found"], F.array(piece)))
        return F.when(start >= length, state).otherwise(
            F.struct(following.alias("start"), grown.alias("found"))
        )

    return F.aggregate(turns, start_state, advance, lambda state: state["found"])
