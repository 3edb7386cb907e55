"""Batch embedding behind a plug-in, with an offline default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1536  # Fixed value: default vector length.

# A model factory runs once per Python worker and returns "texts -> matrix".
Model = Callable[[Sequence[str]], np.ndarray]
ModelFactory = Callable[[], Model]


class HashedTerms:
    """Offline stand-in for a hosted model: hashed term counts, length 1.

    A term is a run of ``[a-z0-9]`` in the lower-cased text; its slot is the
    first 32 bits of its MD5 modulo the vector length.
    """

    def __init__(self, dim: int = DIMENSIONS):
        self.dim = dim

    def __call__(self) -> Model:
        terms = re.compile("[a-z0-9]+")
        dim = self.dim

        def embed(texts: Sequence[str]) -> np.ndarray:
            slots: dict[str, int] = {}  # one batch's vocabulary
            places: list[int] = []
            for row, text in enumerate(texts):
                start = row * dim
                for term in terms.findall(text.lower()):
                    slot = slots.get(term)
                    if slot is None:
                        slot = slots[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim
                    places.append(start + slot)
            counts = np.bincount(places, minlength=len(texts) * dim) if places else np.zeros(len(texts) * dim)
            out = counts.reshape(len(texts), dim).astype(np.float64)
            lengths = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
            np.divide(out, lengths, out=out, where=lengths > 0)
            return out.astype(np.float32)

        return embed


def embed(
    df: DataFrame,
    text_col: str = "text",
    model: ModelFactory | None = None,
    output_col: str = "embedding",
    batch_size: int = 256,
) -> DataFrame:
    """Add one ARRAY<FLOAT> vector per row; row order and columns are kept.

    ``model`` is loaded once per Python worker. Texts reach it in batches of at
    most ``batch_size``. Filter rows before calling: every row is embedded.
    """
    load = model or HashedTerms()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = load()
        for texts in batches:
            for at in range(0, len(texts), batch_size):  # vectors leave as they come; a batch of Arrow's may have 40 times as many
                some = texts.slice(at, batch_size).to_pylist()
                part = np.asarray(run([text or "" for text in some]), dtype=np.float32)
                if len(part) != len(some):
                    raise ValueError(f"{len(part)} vectors for {len(some)} texts")
                ends = np.arange(len(some) + 1, dtype=np.int32) * part.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))

    return df.withColumn(output_col, vectors(F.col(text_col)))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, keys: Sequence[str] = ("doc_id", "chunk_index")) -> DataFrame:
    """Join vectors made elsewhere to their chunks, by key rather than position."""
    return chunks.join(vectors.select(*keys, "embedding"), list(keys))


def nonzero_terms(vectors: DataFrame, keys: Sequence[str], vector_col: str = "embedding") -> DataFrame:
    """The long form of sparse vectors: one row (keys, slot, weight) per entry."""
    return (
        vectors.select(*keys, F.posexplode_outer(vector_col).alias("slot", "weight"))
        .filter(F.col("weight") != 0)
        .select(*keys, F.col("slot").cast("bigint").alias("slot"), F.col("weight").cast("double").alias("weight"))
    )
