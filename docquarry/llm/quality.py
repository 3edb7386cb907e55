"""Document quality by a regularised quadratic discriminant.

Each class (label 0 and 1) is a normal density over transformed document
statistics. Its covariance is shrunk towards the pooled one and towards that
one's diagonal. The score is the probability of label 1, from
the difference of the two log densities; Mahalanobis distances use Cholesky
factors made once and sent with the tasks.

The sums behind means and covariances (one small matrix per class) are taken by
Spark over all labelled training rows, so only those matrices reach the driver.
Nothing but the text enters a score.

Defined results: null and empty texts have the statistics of an empty text and
get a score; rows without a doc_id have no label; repeated rows are scored each; a document with several labels
counts once with each; labels other than 0 and 1 and null ones are left out;
with fewer than two labelled rows of a class the score is 0.5 for all; empty tables
give no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrays import document_of, mix, pieces, text_bytes, word_hashes, words_in
from docquarry.llm.tables import doc_columns, kept

ACCEPT = 0.7
PIECE = 1 << 20  # bytes of text whose statistics are taken at a time
TO_POOLED, TO_DIAGONAL = 0.5, 0.3
FEW_BYTES, FEW_WORDS, FEW_LINES = 20, 5, 3  # added below every share, so that a short text shows no extreme one
_KINDS = 8
_UPPER, _LOWER, _DIGIT, _BLANK, _LINE, _MARK, _SENTENCE, _HIGH = range(_KINDS)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
    kinds[[9, 11, 12, 13, 32]], kinds[10] = _BLANK, _LINE
    kinds[[ord(c) for c in ".,;:!?'\"-()"]] = _SENTENCE
    return kinds


BYTE_KINDS = _byte_kinds()
LINE_FEED = np.arange(256) == 10
STATISTICS = (
    "bytes", "words", "word_length", "word_length_spread", "upper", "digit", "blank", "line", "mark", "sentence", "high",
    "marked_words", "upper_words", "repeated_words", "top_word", "repeated_pairs", "line_length", "repeated_lines", "word_ends", "pairs_alike",
)


def _per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of word values by document, from the positions of the documents' first words."""
    sums = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, by owner."""
    keys = mix(values ^ mix(owner.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.r_[at, len(keys)])
    who = owner[order][at]
    most = np.zeros(n)
    np.maximum.at(most, who, counts)
    return np.bincount(who, minlength=n).astype(float), most


def document_statistics(table: pa.Table) -> np.ndarray:
    """One row of ``STATISTICS`` per document of a piece; shares are in 0 to 1, sizes in logarithms."""
    data, offsets = text_bytes(table.column("text"))
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = BYTE_KINDS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * _KINDS + kinds, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    starts, ends, first = words_in(data, offsets)
    words = np.diff(first).astype(float)
    length = (ends - starts).astype(float)
    doc = document_of(first)
    each = np.maximum(words, 1)
    mean = _per_document(length, first) / each
    spread = np.sqrt(np.maximum(_per_document(length * length, first) / each - mean * mean, 0))
    marks = np.r_[0, np.cumsum(kinds == _MARK)]
    uppers = np.r_[0, np.cumsum(kinds == _UPPER)]
    marked = _per_document(marks[ends] > marks[starts], first)
    shouted = _per_document(uppers[ends] - uppers[starts] >= 2, first)
    ended = _per_document(kinds[ends - 1] == _SENTENCE, first)
    hashes = word_hashes(data, starts, ends)
    distinct, top = _distinct(hashes, doc, n)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, _ = _distinct(mix(hashes[inside]) + hashes[inside + 1], doc[inside], n)
    alike = np.bincount(doc[inside], hashes[inside] == hashes[inside + 1], n)
    # lines: cut at line feeds, white space inside counts
    begin, finish, line_first = words_in(data, offsets, LINE_FEED)
    lines = np.diff(line_first).astype(float)
    different, _ = _distinct(word_hashes(data, begin, finish), document_of(line_first), n)
    share = counts / (size + FEW_BYTES)[:, None]
    some = words + FEW_WORDS
    repeated = np.maximum(words - 1, 0) - pairs
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, spread, share[:, _UPPER], share[:, _DIGIT], share[:, _BLANK], share[:, _LINE], share[:, _MARK],
        share[:, _SENTENCE], share[:, _HIGH], marked / some, shouted / some, (words - distinct) / some, top / some, repeated / some,
        np.log1p(size / np.maximum(lines, 1)), (lines - different) / (lines + FEW_LINES), ended / some, alike / some])


def transformed(statistics: np.ndarray) -> np.ndarray:
    """Square roots of shares even out their spread; sizes are logarithms already."""
    out = statistics.copy()
    for i, name in enumerate(STATISTICS):
        if name not in ("bytes", "words", "line_length"):
            out[:, i] = np.sqrt(np.maximum(out[:, i], 0))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in pieces(batches, size=PIECE):
        x = transformed(document_statistics(table))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), lists], ["doc_id", "x"])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of every row, in the order of ``STATISTICS``."""
    return doc_columns(docs).mapInArrow(_describe, "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, sums and products of the statistics by label, one row per label and task."""
    width = len(STATISTICS)
    total = np.zeros((2, 1 + width + width * width))
    for batch in batches:
        x, label = batch.column("x").flatten().to_numpy().reshape(-1, width), batch.column("label").to_numpy()
        for k in (0, 1):
            own = x[label == k]
            total[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["label", "moments"])


class Discriminant:
    """Two normal densities with shrunk covariances; ``score`` gives the probability of label 1."""

    def __init__(self, moments: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL):
        width = len(STATISTICS)
        counts = moments[:, 0]
        self.ready = bool((counts >= 2).all())
        if not self.ready:
            return
        means = moments[:, 1 : 1 + width] / counts[:, None]
        products = moments[:, 1 + width :].reshape(2, width, width)
        scatter = [products[k] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / counts.sum()
        scale = np.sqrt(np.maximum(np.diagonal(pooled), 1e-8))
        self.scale, self.means = scale, means / scale
        self.prior = np.log(counts[1] / counts[0])
        self.factors, self.sizes = [], []
        for k in (0, 1):
            own = (1 - to_pooled) * scatter[k] / counts[k] + to_pooled * pooled
            own = own / np.outer(scale, scale)
            own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diagonal(own)) + 1e-3 * np.eye(width)
            factor = np.linalg.cholesky(own)
            self.factors.append(np.linalg.inv(factor))
            self.sizes.append(2 * np.log(np.diagonal(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        density = []
        for k in (0, 1):
            far = (x / self.scale - self.means[k]) @ self.factors[k].T
            density.append(-0.5 * ((far * far).sum(1) + self.sizes[k]))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -40, 40)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(described: DataFrame, labels: DataFrame, held_out=is_held_out) -> Discriminant:
    """A discriminant from ``described(doc_id, x)`` and ``labels(doc_id, quality)``, without the rows held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter("label IN (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    sums = described.join(known, "doc_id").select("x", "label").mapInArrow(_moments, "label int, moments array<double>")
    width = 1 + len(STATISTICS) + len(STATISTICS) ** 2
    added = sums.select("label", F.posexplode("moments").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros((2, width))
    for r in added:
        moments[r["label"], r["i"]] = r["x"]
    return Discriminant(moments)


def scored(described: DataFrame, model: Discriminant, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``described``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= accept).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = described.withColumn("held_out", is_held_out(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a discriminant fitted here. Texts are read once."""
    described = kept(statistics(docs), "statistics")
    return scored(described, fit(described, labels), accept)


def accepted(docs: DataFrame, model: Discriminant, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text scores ``accept`` or more, decided row by row without a shuffle."""
    rows = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"])
            good = [model.score(transformed(document_statistics(table))) >= accept for table in pieces([texts], size=PIECE)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return rows.mapInArrow(run, rows.schema)
