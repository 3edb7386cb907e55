"""Terms of a question, and their marks in a source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words never highlighted.
STOP_WORDS = (
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how",
    "this", "that", "these", "those", "with", "from", "about", "into", "your",
    "their", "there", "have", "does", "doing", "list", "details", "missing",
    "main", "mainly", "document", "the", "and", "for",
)
MAX_TERMS = 8  # Fixed value.


def highlight_terms(question: Column) -> Column:
    """First 8 distinct words of four or more ASCII letters or digits."""
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]{4,}"), F.lit(0))
    stop = F.array(*[F.lit(word) for word in STOP_WORDS])
    kept = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(kept), 1, MAX_TERMS)


def highlight_text(text: Column, terms: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Wrap every case-insensitive occurrence, earlier terms first.

    Terms are alphanumeric, so they need no escaping in the pattern.
    """
    pattern = F.concat(F.lit("(?i)("), F.array_join(terms, "|"), F.lit(")"))
    marked = F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}"))
    return F.when(F.size(terms) > 0, marked).otherwise(text)
