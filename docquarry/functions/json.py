"""Strict JSON tests; Spark's parsers alone accept trailing and loose text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_strict_json(raw: Column) -> Column:
    """True when the whole string is exactly one JSON value.

    ``try_parse_json`` stops after the first complete value. Wrapped in
    brackets, a string with anything more fails to parse or has another size.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    entries = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.coalesce(F.size(entries) == 1, F.lit(False))


def is_json_record(raw: Column) -> Column:
    """Strictly valid and not the JSON literal ``null``."""
    return is_strict_json(raw) & (F.btrim(raw, F.lit(" \t\r\n")) != "null")
