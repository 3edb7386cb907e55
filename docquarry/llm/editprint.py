"""Document fingerprints by a randomised edit embedding.

The embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over a text: at
each step it writes the character it stands on, and a random bit, shared by
all texts and fixed by step and character, says whether it goes on to the next. Texts
a few edits apart soon walk in step again, so edit distance becomes Hamming
distance. A walk goes through the whole text without a restart, one look into a table of stays
for each character; the random bits repeat after ``STEPS`` steps.

A fingerprint samples ``SAMPLES`` bits of the embedding in each octave of the
text (its first eight characters, the next eight, the next 16, the next 32, ...). The
positions are the same for all texts, so texts of different length compare where
both reach. ``likeness`` is the share of equal bits, weighted by the characters
of each octave and rescaled so that unrelated texts come to about 0 and equal
ones to 1. ``edit_search`` finds the neighbours of a query set by banding of sampled
bits and verifies them.

Defined results: null and empty texts have the fingerprint of an empty text;
equal texts have equal fingerprints; of rows with the same doc_id the greater
text comes first; rows without a doc_id come after all others; a single row is
its own next document; an empty table gives no rows; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.arrays import pieces
from docquarry.llm.tables import doc_columns

SAMPLES, OCTAVES, SHORTEST, BANDED = 128, 40, 8, 4
STEPS = 1 << 12
_RANDOM = np.random.default_rng(8)
WALK = _RANDOM.integers(0, 2, (STEPS, 256)).astype(np.uint8)
WALK[-1] = 1
BITS = _RANDOM.integers(0, 2, (OCTAVES, SAMPLES, 256)).astype(np.uint8)  # symbol 0 is past the end of a text
FIRST_CHAR = np.array([0] + [SHORTEST << i for i in range(OCTAVES - 1)])
WIDTH = np.maximum(FIRST_CHAR, SHORTEST)
# a walk takes two steps for a character on average
_PLACE = 2 * FIRST_CHAR[:, None] + (_RANDOM.random((OCTAVES, SAMPLES)) * 2 * WIDTH[:, None]).astype(np.int64)
AT_CHAR = _PLACE // 2
_CHUNK = 1 << 16


def _stays() -> list[bytes]:
    """For each symbol: how many steps a walk that comes to it at a step (modulo ``STEPS``) stays on it."""
    table = np.ones((STEPS, 256), np.uint8)
    for step in range(STEPS - 2, -1, -1):
        table[step] = np.where(WALK[step], 1, table[step + 1] + 1)
    return [column.tobytes() for column in np.ascontiguousarray(table.T)]


STAYS = _stays()


def octaves(chars: np.ndarray) -> np.ndarray:
    """How many octaves a text of so many characters reaches."""
    return np.searchsorted(FIRST_CHAR, np.maximum(chars, 1), "left")


def arrivals(symbols: np.ndarray, step: int = 0) -> np.ndarray:
    """The steps at which a walk that stands on the first symbol at ``step`` comes to each symbol, and past the last."""
    out = np.empty(len(symbols) + 1, np.int64)
    out[0] = step
    stays, last = STAYS, STEPS - 1
    for a in range(0, len(symbols), _CHUNK):
        part = symbols[a : a + _CHUNK].tobytes()
        out[a + 1 : a + 1 + len(part)] = [step := step + stays[symbol][step & last] for symbol in part]
    return out


def _bits(symbols: np.ndarray, reached: np.ndarray, count: int) -> np.ndarray:
    """Sampled bits of a text, one row per octave."""
    at = np.searchsorted(reached, _PLACE[:count], "right") - 1
    symbol = np.where(at < len(symbols), np.r_[symbols, np.uint8(0)][np.minimum(at, len(symbols))], 0)
    return BITS[np.arange(count)[:, None], np.arange(SAMPLES), symbol]


class Prints:
    """Fingerprint bits of some texts: ``rows(i)`` has one row per octave."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray, chars: np.ndarray):
        self.bits, self.chars, self.counts = bits, chars, counts
        self.first = np.r_[0, np.cumsum(counts)]

    def rows(self, i: int, octave_count: int) -> np.ndarray:
        own = self.bits[self.first[i] : self.first[i + 1]]
        if octave_count > len(own):
            own = np.vstack([own, BITS[len(own) : octave_count, :, 0]])
        return own

    def text(self, i: int) -> str:
        return np.packbits(self.bits[self.first[i] : self.first[i + 1]]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, chars: int) -> float:
    """Weighted share of equal bits of two fingerprints of as many octaves; ``chars`` is the longer text's length."""
    if chars == 0:
        return 1.0
    count = len(a)
    valid = AT_CHAR[:count] < chars
    begin = FIRST_CHAR[:count]
    weight = np.minimum(np.r_[begin[1:], chars], chars) - np.minimum(begin, chars)
    seen = valid.sum(1)
    weight = np.where(seen > 0, weight, 0)
    same = ((a == b) & valid).sum(1) / np.maximum(seen, 1)
    if not weight.sum():
        return float(np.array_equal(a, b))
    return float(np.clip(2 * (same @ weight) / weight.sum() - 1, 0, 1))


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (1 + (points ^ (points >> 8)) % 255).astype(np.uint8)


def fingerprint_texts(texts: list[str], edits: list[tuple[int, str] | None]) -> tuple[Prints, Prints]:
    """Prints of the texts, and of their edited forms: ``edits[i]`` is (characters kept, new ending), or None."""
    none = np.zeros((0, SAMPLES), np.uint8)
    plain, changed = [], []
    chars, new_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, (text, edit) in enumerate(zip(texts, edits)):
        own = _symbols(text)
        reached = arrivals(own)
        chars[i] = len(own)
        plain.append(_bits(own, reached, int(octaves(chars[i]))))
        if edit is None:
            changed.append(none)
            continue
        # an edited text goes on from where the kept part ends
        tail = _symbols(edit[1])
        new_chars[i] = edit[0] + len(tail)
        walked = np.r_[reached[: edit[0]], arrivals(tail, int(reached[edit[0]]))]
        changed.append(_bits(np.r_[own[: edit[0]], tail], walked, int(octaves(new_chars[i]))))

    def prints(bits: list[np.ndarray], sizes: np.ndarray) -> Prints:
        return Prints(np.concatenate([none, *bits]), np.array([len(b) for b in bits], np.int64), sizes)

    return prints(plain, chars), prints(changed, new_chars)


def compare(a: Prints, i: int, b: Prints, j: int) -> float:
    count = max(a.counts[i], b.counts[j])
    return likeness(a.rows(i, count), b.rows(j, count), int(max(a.chars[i], b.chars[j])))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            texts = [t.decode("utf-8", "replace") for t in table.column("text").to_pylist()]
            prints, _ = fingerprint_texts(texts, [None] * len(texts))
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(prints.chars), pa.array([prints.text(i) for i in range(len(texts))])],
                ["doc_id", "n_chars", "fingerprint"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(part, key, doc_id, text, peek) sorted by descending doc_id within parts, each part ending
    with a copy of the row that comes after it (``peek``); after the last row comes the first.

    Texts are shuffled once. The bounds of the parts are quantiles of doc_id, as many as there are parts; with several
    parts to a partition, partitions come out even.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = doc_columns(docs).select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, keys.to_numpy(), "right")).astype(np.int32))

    placed = rows.select(part_of("key").alias("part"), "key", "doc_id", "text")
    heads = rows.select(part_of("key").alias("part"), "key").groupBy("part").agg(F.max("key").alias("key"))  # one row per part
    order = Window.orderBy("part")
    last = F.max("part").over(Window.partitionBy())
    heads = heads.select("key", F.coalesce(F.lag("part").over(order), last).alias("part"))
    ahead = rows.join(F.broadcast(heads), "key").groupBy("part", "key", "doc_id").agg(F.max("text").alias("text"))
    both = placed.withColumn("peek", F.lit(False)).union(ahead.select("part", "key", "doc_id", "text", F.lit(True).alias("peek")))
    return both.repartition("part").sortWithinPartitions("part", "peek", F.desc("key"), F.desc("text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text ends, in place of its last third, with the first as many characters of the next document by descending doc_id.
    """

    def rows_of(found: pa.Table) -> pa.RecordBatch:
        """Results of all rows but the last, whose successor is not here."""
        texts = [t.decode("utf-8", "replace") for t in found.column("text").to_pylist()]
        peek, part = found.column("peek").to_pylist(), found.column("part").to_pylist()
        wanted = [i for i in range(len(texts) - 1) if not peek[i] and part[i] == part[i + 1]]
        edits: list[tuple[int, str] | None] = [None] * len(texts)
        for i in wanted:
            size = len(texts[i])
            edits[i] = (size - size // 3, texts[i + 1][: size // 3])
        plain, changed = fingerprint_texts(texts, edits)
        digests = [hashlib.sha256((texts[i][: edits[i][0]] + edits[i][1]).encode("utf-8", "surrogatepass")).hexdigest() for i in wanted]
        return pa.RecordBatch.from_arrays(
            [found.column("doc_id").combine_chunks().take(pa.array(wanted, pa.int64())), pa.array(plain.chars[wanted]), pa.array(digests, pa.string()),
             pa.array([plain.text(i) for i in wanted], pa.string()), pa.array([changed.text(i) for i in wanted], pa.string()),
             pa.array([compare(plain, i, changed, i) for i in wanted], pa.float64()), pa.array([compare(plain, i, plain, i + 1) for i in wanted], pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for table in pieces(batches):
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            if table.num_rows > 1:
                yield rows_of(table)
            waiting = table.slice(table.num_rows - 1)

    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_order(docs, parts).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edit_search(docs: DataFrame, queries: DataFrame, near: float = 0.8, band: int = 16) -> DataFrame:
    """(query, fingerprint, likeness): for each distinct fingerprint of ``queries(doc_id, text)`` those of
    ``docs`` that share a band of sampled bits of one octave and are alike by ``near`` or more.

    Bands are ``band`` consecutive bits of the last ``BANDED`` octaves that a text reaches in full (the first one, if none), so
    two texts share bands whatever their lengths; those of 0.8 are less than one octave apart and have three octaves or more in common.
    Copies share a fingerprint and are not repeated; ``fingerprints`` gives the documents of each.
    """
    width, octave_size = band // 4, SAMPLES // 4
    full = F.greatest(F.length(F.bin("chars")) - F.lit(SHORTEST.bit_length() - 1), F.lit(1))
    numbers = F.sequence(F.greatest(full - BANDED, F.lit(0)), full - 1)
    bands = F.flatten(F.transform(numbers, lambda o: F.transform(
        F.sequence(F.lit(0), F.lit(octave_size // width - 1)),
        lambda i: F.struct(o.alias("octave"), i.alias("i"), F.substr("fingerprint", o * octave_size + i * width + 1, F.lit(width)).alias("b")))))

    def banded(rows: DataFrame) -> DataFrame:
        prints = fingerprints(rows).groupBy("fingerprint").agg(F.max("n_chars").alias("chars"))
        return prints.select("fingerprint", "chars", F.explode(bands).alias("k")).select("fingerprint", "chars", "k.*")

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series, chars: pd.Series) -> pd.Series:
        def bits(value: str, count: int) -> np.ndarray:
            own = np.unpackbits(np.frombuffer(bytes.fromhex(value), np.uint8)).reshape(-1, SAMPLES)
            return np.vstack([own, BITS[len(own) : count, :, 0]])

        counts = [max(len(p), len(q)) // octave_size for p, q in zip(x, y)]
        return pd.Series([likeness(bits(p, c), bits(q, c), int(n)) for p, q, c, n in zip(x, y, counts, chars)], dtype=float)

    asked, known = banded(queries).alias("a"), banded(docs).alias("b")
    pairs = asked.join(known, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("octave", "i", "b")]).select(
        F.col("a.fingerprint").alias("query"), F.col("b.fingerprint").alias("fingerprint"), F.greatest("a.chars", "b.chars").alias("chars")).distinct()
    return pairs.withColumn("likeness", alike("query", "fingerprint", "chars")).filter(F.col("likeness") >= near).drop("chars")
