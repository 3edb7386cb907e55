"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import attribution, brown, collocations, contamination, editprint, licenses, lines, packing, quality, runs, simhash, substrings, topk
from docquarry.llm.tables import read


def op1_brown_scores(spark: SparkSession, sf: str) -> DataFrame:
    return brown.score_texts(read(spark, sf, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"))


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.without_repeated_runs(read(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contained_items(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(read(spark, sf, "documents")).drop("spans")


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.without_repeated_lines(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op8_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return editprint.edited_fingerprints(read(spark, sf, "documents"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the opening quarter, the middle and the closing quarter of each document."""
    size = F.char_length(F.coalesce("text", F.lit("")))
    edges = [F.lit(0), F.floor(size / 4), size - F.floor(size / 4), size]
    parts = [
        F.struct(F.lit(name).alias("section"), a.cast("int").alias("start"), b.cast("int").alias("end"))
        for name, a, b in zip(("opening", "middle", "closing"), edges, edges[1:])
    ]
    return attribution.token_counts(read(spark, sf, "documents"), F.array(*parts), rule="most")


def op10_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(read(spark, sf, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.with_planted_repeats(read(spark, sf, "documents"))))


def op13_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_brown_scores, op2_best_fit_packing, op3_substring_dedup, op4_benchmark_decontamination, op5_license_scan, op6_line_dedup, op7_quality_classifier, op8_document_fingerprints, op9_token_counts, op10_simhash_near_dedup,
        op11_exact_top_k, op12_periodic_runs, op13_phrase_collocations)
}
