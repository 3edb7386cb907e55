"""Benchmark decontamination: which test items stand inside which documents.

Containment of an item is the share of its distinct shingles (five words) that a
document holds; an item is inside at 0.8 or more. The search uses MinHash
sketches by size: items are split by their number of shingles (powers of two),
and an item's sketch is its smallest shingle hashes, one more than may be
missing, so that a document at the threshold shares at least one. Each size
class has the largest hash of its sketches as a bound; document shingles above
all bounds never leave the scan, and those left are looked up in the sketches.
Long documents need no signature of their own. Candidates are verified by
exact containment of the shingle texts.

Everything is DataFrame expressions. Words are runs of ASCII letters, digits
and non-ASCII characters, A-Z in lower case.

Defined results: null and empty texts hold no item; items without words match
nothing; an item of fewer than five words has one shingle, all its words, which
must stand in the document; equal items are found each under their own id;
rows with the same doc_id are one document, rows without one are not reported; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.tables import doc_columns, kept

SHINGLE, THRESHOLD = 5, 0.8
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BREAKS), lambda w: w != "")


def _runs(words: Column, length: int, make) -> Column:
    """``make`` of every run of ``length`` words; an empty array if there is none."""
    last = F.size(words) - length + 1
    at = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    found = F.transform(at, lambda i: make([F.get(words, i + (k - 1)) for k in range(length)]))
    return F.when(last >= 1, found)


def _hashes(words: Column, length: int) -> Column:
    return _runs(words, length, lambda run: F.xxhash64(*run))


def _texts(words: Column, length: int) -> Column:
    return _runs(words, length, lambda run: F.concat_ws(" ", *run))


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, length, text, hash, n): the distinct shingles of each item and their number."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text").cast("string")).alias("w"))
    sized = words.filter("size(w) > 0 AND item_id IS NOT NULL").withColumn("length", F.least(F.size("w"), F.lit(shingle)))
    texts = F.coalesce(*[F.when(F.col("length") == k, _texts(F.col("w"), k)) for k in range(1, shingle + 1)])
    # a shingle is named by its words; the hash is taken over them one by one, as for the documents
    each = sized.select("item_id", "length", F.explode(texts).alias("text")).distinct()
    parts = F.split("text", " ")
    hashes = F.coalesce(*[F.when(F.col("length") == k, F.xxhash64(*[F.get(parts, F.lit(i)) for i in range(k)])) for k in range(1, shingle + 1)])
    counts = each.groupBy("item_id").agg(F.count("*").alias("n"))
    return each.withColumn("hash", hashes).join(counts, "item_id")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, length, size_class, hash): the smallest hashes of each item, one more than may be missing."""
    allowed = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    smallest = F.slice(F.array_sort(F.collect_set("hash")), 1, F.max(allowed).cast("int"))
    listed = shingles.groupBy("item_id", "length", "n").agg(smallest.alias("hashes"))
    return listed.select("item_id", "length", F.floor(F.log2("n")).cast("int").alias("size_class"), F.explode("hashes").alias("hash"))


def _sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint for a table of counted size; a larger one is joined by shuffling, with the same rows."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of the items inside documents."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    shingles = kept(item_shingles(items, shingle), "item-shingles")
    sketch = kept(sketches(shingles, threshold), "item-sketches")
    bounds = sketch.groupBy("length", "size_class").agg(F.max("hash").alias("bound"))
    most = {r["length"]: r["bound"] for r in bounds.groupBy("length").agg(F.max("bound").alias("bound")).collect()}  # one row per length
    texts = doc_columns(docs).filter("doc_id IS NOT NULL")
    worded = texts.select("doc_id", words_of(F.col("text")).alias("w"))

    # search: the small hashes of each document against the sketches
    low = [
        worded.select("doc_id", F.lit(length).alias("length"), F.explode(_hashes(F.col("w"), length)).alias("hash")).filter(F.col("hash") <= bound)
        for length, bound in sorted(most.items())
    ]
    none = texts.sparkSession.range(0)
    empty = none.selectExpr("id AS doc_id", "0 AS length", "id AS hash")
    found = _union(low, empty).join(_sized(sketch.select("item_id", "length", "hash"), 32), ["length", "hash"])
    candidates = kept(found.select("doc_id", "item_id").distinct(), "candidates")

    # verification: all shingle texts of the candidate documents against those of their items
    near = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words_of(F.col("text")).alias("w"))
    spelled = [
        near.select("doc_id", F.lit(length).alias("length"), F.explode(F.array_distinct(_texts(F.col("w"), length))).alias("text"))
        for length in sorted(most)
    ]
    wanted = shingles.select("item_id", "length", "text", "n")
    empty = none.selectExpr("id AS doc_id", "0 AS length", "'' AS text")
    hits = _union(spelled, empty).join(_sized(wanted, 128), ["length", "text"]).join(candidates, ["doc_id", "item_id"], "left_semi")
    held = hits.select("doc_id", "item_id", "n", "text").distinct().groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_found"))
    return held.filter(F.col("n_found") >= F.ceil(F.col("n") * threshold - 1e-9)).select(
        "doc_id", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    """All frames in one; ``empty`` if there is none."""
    found = frames[0] if frames else empty
    for frame in frames[1:]:
        found = found.union(frame)
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without a doc_id stay."""
    held = contained_items(docs, items, **options).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(docs.columns)
