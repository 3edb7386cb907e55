import datetime as dt

import pytest
from pyspark.sql import functions as F

from docquarry.operators import embedding
from docquarry.plans import catalog
from docquarry.plans.ingest import embedded_documents, embedded_pages
from docquarry.sources import store

SMALL = embedding.HashedTerms(16)
DOCS = "doc_id long, file_name string, text string, uploaded_at timestamp"


def docs(spark, *rows):
    return spark.createDataFrame([(d, n, t, dt.datetime(2024, 1, day)) for d, n, t, day in rows], DOCS)


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "store")
    first = docs(spark, (1, "a.txt", "one " * 400, 1), (2, "b.txt", "two", 2), (3, "c.exe", "no", 3), (4, "d.txt", " ", 3))
    store.save_chunks(embedded_documents(first, SMALL, buckets=4), where, 0, buckets=4)
    return where


def state(spark, path):
    return {(r.doc_id, r.chunk_index): (r.text, r.batch_id) for r in store.read_chunks(spark, path).collect()}


def test_save_and_list(spark, path):
    listed = store.list_documents(store.registry(store.read_chunks(spark, path))).collect()
    assert [(r.doc_id, r.file_name, r.chunk_count) for r in listed] == [(2, "b.txt", 1), (1, "a.txt", 3)]
    rows = store.read_chunks(spark, path)
    assert {"doc_id", "chunk_index", "chunk_id", "page", "text", "file_name", "uploaded_at", "embedding"} <= set(rows.columns)
    assert {len(r.embedding) for r in rows.collect()} == {16}


def test_saving_a_batch_again_changes_nothing(spark, path):
    before = state(spark, path)
    again = docs(spark, (1, "a.txt", "one " * 400, 1), (2, "b.txt", "two", 2))
    store.save_chunks(embedded_documents(again, SMALL, buckets=4), path, 0, buckets=4)
    assert state(spark, path) == before


def test_later_batch_wins_per_document(spark, path):
    store.save_chunks(embedded_documents(docs(spark, (1, "a.txt", "new", 4)), SMALL), path, 1, buckets=4)
    assert state(spark, path) == {(1, 0): ("new", 1), (2, 0): ("two", 0)}


def test_saving_a_batch_again_replaces_it_whole(spark, path):
    store.save_chunks(embedded_documents(docs(spark, (1, "a.txt", "alone", 4)), SMALL), path, 0, buckets=4)
    assert state(spark, path) == {(1, 0): ("alone", 0)}
    assert [r.doc_id for r in store.read_registry(spark, path).collect()] == [1]


def test_writers_do_not_share_batches(spark, path):
    store.save_chunks(embedded_documents(docs(spark, (5, "e.txt", "five", 4)), SMALL), path, 0, buckets=4, writer="other")
    assert {d for d, _ in state(spark, path)} == {1, 2, 5}
    with pytest.raises(ValueError):
        store.save_chunks(embedded_documents(docs(spark, (5, "e.txt", "five", 4)), SMALL), path, 1, buckets=8)
    with pytest.raises(ValueError):
        store.save_chunks(embedded_documents(docs(spark, (5, "e.txt", "five", 4)), SMALL), path, 1, writer="a/b")


def test_an_unfinished_batch_is_not_read(spark, path):
    rows = embedded_documents(docs(spark, (5, "e.txt", "five", 4)), SMALL).withColumn("doc_bucket", F.lit(0))
    rows.write.partitionBy("doc_bucket").parquet(f"{path}/chunks/batch_id=9")
    assert {d for d, _ in state(spark, path)} == {1, 2}


def test_many_dead_versions_join_only_their_batches(spark, path, monkeypatch):
    store.save_chunks(embedded_documents(docs(spark, (1, "a.txt", "new", 4)), SMALL), path, 1, buckets=4)
    store.save_chunks(embedded_documents(docs(spark, (7, "g.txt", "seven", 4)), SMALL), path, 2, buckets=4)
    want = state(spark, path)
    dead = spark.createDataFrame([(1, 0)], "doc_id long, batch_id long")
    chunks = spark.read.parquet(f"{path}/chunks").withColumn("batch_id", F.col("batch_id").cast("long"))
    rows = store.without_dead(chunks, dead, broadcast_bytes=0)
    assert {(r.doc_id, r.chunk_index): (r.text, r.batch_id) for r in rows.collect()} == want


def test_delete_and_write_again(spark, path):
    store.delete_documents(spark.createDataFrame([(1,), (1,), (99,)], "doc_id long"), path, 1)
    assert set(state(spark, path)) == {(2, 0)}
    store.save_chunks(embedded_documents(docs(spark, (1, "a.txt", "back", 5)), SMALL), path, 2, buckets=4)
    assert state(spark, path) == {(2, 0): ("two", 0), (1, 0): ("back", 2)}
    store.delete_documents(spark.createDataFrame([(1,)], "doc_id long"), path, 3)
    assert set(state(spark, path)) == {(2, 0)}


def test_compaction_keeps_the_live_rows(spark, path, tmp_path):
    store.save_chunks(embedded_documents(docs(spark, (1, "a.txt", "new", 4)), SMALL), path, 1, buckets=4)
    store.delete_documents(spark.createDataFrame([(2,)], "doc_id long"), path, 2)
    new_path = str(tmp_path / "compacted")
    store.compact(spark, path, new_path, 7, buckets=4)
    before = {k: v[0] for k, v in state(spark, path).items()}
    assert {k: v[0] for k, v in state(spark, new_path).items()} == before
    assert {v[1] for v in state(spark, new_path).values()} == {0}


def test_one_document_reads_one_bucket(spark, path):
    rows = store.read_documents(spark, path, [1])
    assert {r.doc_id for r in rows.collect()} == {1} and rows.count() == 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("doc_bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_deleting_leaves_other_documents_alone(spark, small):
    versions = catalog._versions(spark, small)
    tombstones = spark.createDataFrame([(3, 1)], "doc_id long, batch_id long")
    left = store.latest_chunks(store.without_deleted(versions, tombstones))
    want = store.latest_chunks(versions).filter("doc_id <> 3 OR batch_id > 1")
    assert left.exceptAll(want).count() == 0 and want.exceptAll(left).count() == 0


def test_embedded_pages(spark):
    pages = spark.createDataFrame([(1, 1, "alpha"), (1, 2, ""), (1, 3, "beta")], "doc_id long, page long, text string")
    names = spark.createDataFrame([(1, "f.pdf", dt.datetime(2024, 1, 1))], "doc_id long, file_name string, uploaded_at timestamp")
    got = embedded_pages(pages, names, SMALL).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.page, r.file_name, len(r.embedding)) for r in got] == [
        ("chunk-0", 1, "f.pdf", 16), ("chunk-1", 3, "f.pdf", 16)]


def test_bucket_is_stable(spark):
    row = spark.range(1).select(store.doc_bucket(F.lit(5)).alias("a"), store.doc_bucket(F.lit(5)).alias("b")).first()
    assert row.a == row.b and 0 <= row.a < store.DOC_BUCKETS


def test_registry_follows_saves_and_deletes(spark, path):
    def listed():
        return {r.doc_id: (r.file_name, r.chunk_count) for r in store.read_registry(spark, path).collect()}

    assert listed() == {1: ("a.txt", 3), 2: ("b.txt", 1)}
    store.delete_documents(spark.createDataFrame([(2,)], "doc_id long"), path, 1)
    assert listed() == {1: ("a.txt", 3)}
    store.save_chunks(embedded_documents(docs(spark, (1, "n.txt", "new", 4), (2, "b.txt", "again", 5)), SMALL), path, 2, buckets=4)
    assert listed() == {1: ("n.txt", 1), 2: ("b.txt", 1)}
    plan = store.read_registry(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "/chunks" not in plan and "embedding" not in plan


def test_deleting_nothing_and_everything(spark, path):
    store.delete_documents(spark.createDataFrame([], "doc_id long"), path, 1)
    assert set(d for d, _ in state(spark, path)) == {1, 2}
    store.delete_documents(spark.createDataFrame([(1,), (2,)], "doc_id long"), path, 2)
    assert state(spark, path) == {} and store.read_registry(spark, path).count() == 0


@pytest.mark.parametrize("id_type", ["bigint", "string"])
def test_a_store_that_begins_without_chunks(spark, tmp_path, id_type):
    path = str(tmp_path / "store")
    rows = spark.range(6).select(F.col("id").cast(id_type).alias("doc_id"), F.lit(0).cast("bigint").alias("chunk_index"), F.lit("t").alias("text"),
                                 F.array(F.lit(1.0).cast("float")).alias("embedding"))
    store.save_chunks(rows.limit(0), path, 0, buckets=4, gather=True)
    store.delete_documents(rows.select("doc_id"), path, 0)
    for only in (None, [1, 2]):
        found = store.read_chunks(spark, path) if only is None else store.read_documents(spark, path, only)
        assert found.collect() == [] and found.schema["doc_id"].dataType.simpleString() == id_type
    store.save_chunks(rows, path, 1, gather=True)
    assert store.read_chunks(spark, path).count() == 6 and store.read_documents(spark, path, [1]).count() == 1


def test_a_store_that_begins_with_a_delete(spark, tmp_path):
    path = str(tmp_path / "store")
    store.delete_documents(spark.range(3).withColumnRenamed("id", "doc_id"), path, 0)
    assert store.read_chunks(spark, path).collect() == [] and store.read_registry(spark, path).collect() == []


def files_and_rows(spark, path):
    """Files of each bucket, and rows of the largest."""
    files = spark.read.parquet(f"{path}/chunks").groupBy("doc_bucket", F.input_file_name().alias("file")).count()
    return files.groupBy("doc_bucket").agg(F.count("*").alias("files"), F.max("count").alias("most")).collect()


def test_gathered_files_do_not_grow_with_the_batch(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 16).select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("chunk_index"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "150k")
    try:
        store.save_chunks(rows, str(tmp_path / "a"), 0, buckets=2, gather=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert all(r.files >= 4 and r.most < 10_000 for r in files_and_rows(spark, str(tmp_path / "a")))
    assert store.read_chunks(spark, str(tmp_path / "a")).select("doc_id", "text").exceptAll(rows.select("doc_id", "text")).isEmpty()
    assert store.read_registry(spark, str(tmp_path / "a")).count() == 40_000
    store.save_chunks(rows.limit(100), str(tmp_path / "b"), 0, buckets=2, gather=True)
    assert [r.files for r in files_and_rows(spark, str(tmp_path / "b"))] == [1, 1]  # and small ones stay tidy


def test_embedded_files_do_not_grow_with_the_batch(spark, tmp_path, monkeypatch):
    """Every task chunks, embeds and writes a bounded share of the texts, and no upload or page is lost."""
    monkeypatch.setattr(store.files_for, "__defaults__", ("text", 40_000))
    at = F.timestamp_seconds(F.lit(1_704_067_200)).alias("uploaded_at")
    uploads = spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), F.concat("id", F.lit(".txt")).alias("file_name"), F.repeat(F.lit("word "), 40).alias("text"), at)
    store.save_chunks(embedded_documents(uploads, SMALL, buckets=2), str(tmp_path / "a"), 0, buckets=2)
    pages = uploads.select(F.lit(1).alias("doc_id"), F.col("doc_id").alias("page"), "text")  # one large document
    names = spark.range(1, 2).select(F.col("id").alias("doc_id"), F.lit("a.pdf").alias("file_name"), at)
    store.save_chunks(embedded_pages(pages, names, SMALL, buckets=2, chunk_size=10, overlap=0), str(tmp_path / "b"), 0, buckets=2)
    assert [r.files for r in files_and_rows(spark, str(tmp_path / "a"))] == [5, 5]
    assert spark.read.parquet(str(tmp_path / "b" / "chunks")).count() == 2000 * 20
    assert [r.files > 1 for r in files_and_rows(spark, str(tmp_path / "b"))] == [True]
    assert store.read_registry(spark, str(tmp_path / "a")).agg(F.count("*"), F.sum("chunk_count")).first() == (2000, 2000)
