"""Operators of a training-data pipeline: scoring, packing, deduplication,
decontamination, licences, quality, fingerprints and token counts.

Every operator takes and returns DataFrames. Nothing outside this package
imports it; ``queries.py`` and ``oracles.py`` hold its registered queries.
"""
