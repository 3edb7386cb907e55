"""Vector arithmetic as column expressions, for pairs that are already joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double precision; null when either vector is all zero."""
    return dot(left, right) / F.nullif(norm(left) * norm(right), F.lit(0.0))


def unit_vector(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector becomes null."""
    length = norm(vector)
    scaled = F.transform(vector, lambda x: (x.cast("double") / length).cast("float"))
    return F.when(length > 0, scaled)


def rescale_score(score: Column) -> Column:
    """Map cosine [-1, 1] to [0, 1], the form some hosted indexes report."""
    return (score + 1) / 2
