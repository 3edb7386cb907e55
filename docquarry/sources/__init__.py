"""Readers and Parquet-backed tables."""
