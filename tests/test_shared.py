"""Questions and versions that tasks read from the shared folder: plans and results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import retrieval
from docquarry.sources import shared, store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, docs, chunks_each, path, buckets=None):
    draw = np.random.default_rng(7)
    rows = [(d, c, [float(x) for x in draw.normal(size=6).astype(np.float32)]) for d in range(docs) for c in range(chunks_each)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index long, embedding array<float>")
    if buckets:
        df.withColumn("doc_bucket", store.doc_bucket(F.col("doc_id"), buckets)).write.partitionBy("doc_bucket").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.parquet(path)


def asked(spark, count, scope=None):
    draw = np.random.default_rng(8)
    rows = [(f"q{i}", scope(i) if scope else None, [float(x) for x in draw.normal(size=6)]) for i in range(count)]
    return spark.createDataFrame(rows, "query_id string, scope string, embedding array<float>")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_ten_blocks_of_questions_in_one_scan(spark, tmp_path, monkeypatch):
    chunks, queries = table(spark, 40, 5, str(tmp_path / "chunks")), asked(spark, 300)
    want = rows_of(retrieval.top_k(queries, chunks, 4))
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 10)
    fetched = []
    monkeypatch.setattr(retrieval, "_fetch_blocks", lambda *a: fetched.append(a))
    found = retrieval.top_k(queries, chunks, 4, block_bytes=300 * 6 * 8 // 10)
    assert plan(found).count("FileScan") == 1 and not fetched
    assert rows_of(found) == want and len(want) == 1200


def test_blocks_are_read_again_for_every_buffer(spark, tmp_path, monkeypatch):
    from docquarry.operators.scoring import SharedBlockScorer

    chunks, queries = table(spark, 40, 5, str(tmp_path / "chunks")), asked(spark, 60)
    want = rows_of(retrieval.top_k(queries, chunks, 3))
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 10)
    monkeypatch.setattr(retrieval, "SharedBlockScorer", lambda *a: SharedBlockScorer(*a, buffer_bytes=1))
    assert rows_of(retrieval.top_k(queries, chunks, 3, block_bytes=500)) == want


def test_blocks_pass_the_driver_only_where_tasks_cannot_open_the_folder(spark, tmp_path, monkeypatch):
    chunks, queries = table(spark, 20, 4, str(tmp_path / "chunks")), asked(spark, 60)
    want = rows_of(retrieval.top_k(queries, chunks, 3))
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 10)
    monkeypatch.setattr(retrieval, "write_parts", lambda *a: None)
    assert rows_of(retrieval.top_k(queries, chunks, 3, block_bytes=1000)) == want


def test_repeated_and_missing_ids_are_errors(spark, tmp_path, monkeypatch):
    chunks, queries = table(spark, 10, 2, str(tmp_path / "chunks")), asked(spark, 30)
    nameless = queries.withColumn("query_id", F.when(F.col("query_id") != "q3", F.col("query_id")))
    for few in (2048, 10):
        monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
        with pytest.raises(Exception, match="query ids must be unique"):
            retrieval.top_k(queries.union(queries.limit(1)), chunks, 3).collect()
        with pytest.raises(Exception, match="a question without an id"):
            retrieval.top_k(nameless, chunks, 3).collect()
    with pytest.raises(Exception, match="a chunk without an id"):
        retrieval.top_k(queries, chunks.withColumn("chunk_index", F.lit(None).cast("long")), 3).collect()


def test_many_scopes_prune_partitions_at_run_time(spark, tmp_path):
    chunks = table(spark, 6000, 1, str(tmp_path / "chunks"), buckets=16)
    queries = asked(spark, 5000, scope=str)
    found = retrieval.top_k_in_document(queries, chunks, 2, buckets=16)
    assert "dynamicpruning" in plan(found)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(f"q{i}", i) for i in range(5000)}
    few = retrieval.top_k_in_document(asked(spark, 1500, scope=str), chunks, 2, buckets=16)  # one block, buckets named
    assert few.count() == 1500


def test_dead_versions_meet_vectors_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = table(spark, 60, 4, str(tmp_path / "chunks")).withColumn("text", F.lit("first"))
    store.save_chunks(rows, path, 0, buckets=4, gather=True)
    store.save_chunks(rows.filter("doc_id % 2 = 0").withColumn("text", F.lit("second")), path, 1, gather=True)
    store.delete_documents(rows.select("doc_id").filter("doc_id % 5 = 0"), path, 0)
    columns = ["doc_id", "chunk_index", "text"]
    want = rows_of(store.read_chunks(spark, path).select(columns))
    live = store.read_chunks(spark, path, broadcast_bytes=0)
    assert "Exchange" not in plan(live) and "Broadcast" not in plan(live)
    assert rows_of(live.select(columns)) == want
    assert {(r[0], r[2]) for r in want} == {(d, "second" if d % 2 == 0 else "first") for d in range(60) if d % 5}


def test_registered_documents_meet_vectors_without_a_shuffle(spark, tmp_path):
    chunks = table(spark, 60, 4, str(tmp_path / "chunks"), buckets=4)
    registry = chunks.select("doc_id").distinct().filter("doc_id % 3 = 0")
    found = retrieval.registered_chunks(chunks, registry, buckets=4, broadcast_rows=5)
    assert "Exchange" not in plan(found)
    want = rows_of(retrieval.registered_chunks(chunks, registry).select("doc_id", "chunk_index"))
    assert rows_of(found.select("doc_id", "chunk_index")) == want and len(want) == 80
    unbucketed = retrieval.registered_chunks(chunks.drop("doc_bucket"), registry, buckets=4, broadcast_rows=5)
    assert rows_of(unbucketed.select("doc_id", "chunk_index")) == want


def test_parts_with_text_keys_and_none_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), (None, 1)], "doc_id string, batch_id long").withColumn("b", F.lit(0))
    keys = rows.filter("doc_id = 'a' AND batch_id = 1")
    for keep, count in ((True, 1), (False, 3)):
        assert shared.filtered_by_parts(rows, keys, ["doc_id", "batch_id"], F.lit(0), keep).count() == count
        assert shared.filtered_by_parts(rows, keys.limit(0), ["doc_id", "batch_id"], F.lit(0), keep).count() == (0 if keep else 4)
