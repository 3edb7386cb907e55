"""Whole jobs composed from operators, and the registered query catalogue."""
