"""Column expressions (and the one chunk UDF) shared by the operators."""
