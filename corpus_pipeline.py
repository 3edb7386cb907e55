"""A training-data pipeline over ``documents``: reject poor texts, drop repeated
lines, keep one document of each near-duplicate group, drop documents that hold
benchmark items, and pack the rest into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage's rows to the shared
folder and reads them again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import contamination, lines, packing, quality, simhash
from docquarry.llm.tables import kept, read


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier accepts; it learns from the labelled ones."""
    model = quality.fit(kept(quality.statistics(docs), "statistics"), read(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars follows the text."""
    cut = lines.without_repeated_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    return simhash.first_of_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

# a classifier and a tokenizer are beyond SQL; tests/llm compares each stage with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = kept(docs, "stage-" + name.replace(" ", "-"))
    return docs
