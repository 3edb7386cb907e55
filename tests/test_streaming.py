import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators import chunking, embedding, logs
from docquarry.operators.throttle import Limit, admission_replay
from docquarry.plans import catalog
from docquarry.plans.ingest import embedded_documents
from docquarry.sources import store
from docquarry.streaming.admission import read_decisions, start_admission
from docquarry.streaming.ingest import once_per_upload, start_ingest
from docquarry.streaming.keyed_admission import start_keyed_admission
from docquarry.streaming.usage import kept_routes, kept_summary, live_summary, requests_per_window, start_usage_log, start_usage_report


def files_of(df, path, order, parts):
    """The table as several files, to be streamed one per micro-batch."""
    numbered = df.withColumn("_p", F.ntile(parts).over(Window.orderBy(order)))
    for p in range(1, parts + 1):
        numbered.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_ingest_equals_batch(spark, small, tmp_path):
    docs = catalog.uploads(spark, small)
    files_of(docs, str(tmp_path / "in"), "doc_id", 3)
    model = embedding.HashedTerms(16)
    query = start_ingest(stream_of(spark, docs, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), model, buckets=4)
    query.awaitTermination()
    got = store.read_chunks(spark, str(tmp_path / "store"))
    assert got.select("batch_id").distinct().count() == 3
    want = embedded_documents(docs, model)
    columns = ["doc_id", "chunk_index", "text", "file_name", "embedding"]
    assert got.count() == want.count()
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0


def test_stream_leaves_stored_documents_alone(spark, small, tmp_path):
    """A stream with a new checkpoint, and one whose checkpoint was lost, add to the store."""
    path, model = str(tmp_path / "store"), embedding.HashedTerms(16)
    docs = catalog.uploads(spark, small)
    store.save_chunks(embedded_documents(docs.filter("doc_id < 20"), model), path, 0, buckets=4)
    for number, part in enumerate((docs.filter("doc_id >= 20 AND doc_id < 40"), docs.filter("doc_id >= 40 AND doc_id < 60"))):
        files_of(part, str(tmp_path / f"in{number}"), "doc_id", 1)
        start_ingest(stream_of(spark, docs, str(tmp_path / f"in{number}")), path, str(tmp_path / f"cp{number}"), model).awaitTermination()
    want = {r.doc_id for r in embedded_documents(docs.filter("doc_id < 60"), model).select("doc_id").distinct().collect()}
    assert {r.doc_id for r in store.read_chunks(spark, path).select("doc_id").distinct().collect()} == want
    assert {r.doc_id for r in store.read_registry(spark, path).collect()} == want


def test_two_usage_streams_share_a_log(spark, small, tmp_path):
    events = catalog.usage_events(spark, small)
    for number, part in enumerate((events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"))):
        files_of(part, str(tmp_path / f"in{number}"), "event_id", 1)
        start_usage_log(stream_of(spark, events, str(tmp_path / f"in{number}")), str(tmp_path / "log"), str(tmp_path / f"cp{number}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()


def test_live_usage_equals_batch(spark, small, tmp_path):
    events = catalog.usage_events(spark, small)
    files_of(events, str(tmp_path / "in"), "event_id", 4)
    start_usage_log(stream_of(spark, events, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert live_summary(spark, str(tmp_path / "log")).first() == logs.usage_summary(logs.newest(events)).first()


def test_live_admission_equals_batch(spark, small, tmp_path):
    asked = catalog.requests(spark, small).withColumn(
        "client", F.when(F.col("client") % 3 == 0, F.lit("anonymous")).otherwise(F.col("client").cast("string")))
    files_of(asked, str(tmp_path / "in"), "ts", 5)
    limit = Limit(3, 86_400)
    start_admission(stream_of(spark, asked, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), limit).awaitTermination()
    got = read_decisions(spark, str(tmp_path / "out"))
    want = admission_replay(asked, limit)
    columns = ["event_id", "client", "admitted"]
    assert got.count() == asked.count()
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0


def test_restart_continues_where_it_stopped(spark, small, tmp_path):
    """Two runs over a growing folder equal one run over all of it."""
    asked = catalog.requests(spark, small)
    middle = dt.datetime(2024, 1, 15)
    limit = Limit(3, 86_400)
    for half in (asked.filter(F.col("ts") < F.lit(middle)), asked.filter(F.col("ts") >= F.lit(middle))):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream_of(spark, asked, str(tmp_path / "in"))
        start_admission(source, str(tmp_path / "out"), str(tmp_path / "cp"), limit).awaitTermination()
    got = read_decisions(spark, str(tmp_path / "out"))
    want = admission_replay(asked, limit)
    assert got.filter("admitted").count() == want.filter("admitted").count() and got.count() == asked.count()


def test_windowed_counts(spark, small, tmp_path):
    events = catalog.usage_events(spark, small)
    files_of(events, str(tmp_path / "in"), "ts", 3)
    counted = requests_per_window(stream_of(spark, events, str(tmp_path / "in")), "1 day", "1 hour")
    query = (counted.writeStream.format("memory").queryName("windows").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r.window_start.date(), r.route): r.requests for r in spark.table("windows").collect()}
    last = events.agg(F.max("ts")).first()[0].date()
    want = {(r.day, r.route): r.n for r in events.groupBy(F.to_date("ts").alias("day"), "route").agg(F.count("*").alias("n")).collect()
            if r.day < last}
    assert got == want


def test_paged_uploads_through_the_stream(spark, small, tmp_path):
    pages = catalog.paged(spark, small)
    grouped = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page", "text")).alias("pages")).select(
        "doc_id", F.concat(F.lit("talk-"), "doc_id", F.lit(".pdf")).alias("file_name"), F.current_timestamp().alias("uploaded_at"), "pages")
    files_of(grouped, str(tmp_path / "in"), "doc_id", 2)
    model = embedding.HashedTerms(16)
    start_ingest(stream_of(spark, grouped, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), model, buckets=4).awaitTermination()
    got = store.read_chunks(spark, str(tmp_path / "store")).select("doc_id", "chunk_index", "page", "text")
    want = chunking.chunk_pages(pages).select("doc_id", "chunk_index", "page", "text")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_live_admission_with_clocks_days_apart(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(12):
        rows.append((2 * i, "behind", start + dt.timedelta(seconds=i)))
        rows.append((2 * i + 1, "ahead", start + dt.timedelta(days=5, seconds=i)))
    asked = spark.createDataFrame(rows, "event_id long, client string, ts timestamp")
    files_of(asked, str(tmp_path / "in"), "event_id", 4)
    limit = Limit(5, 60)
    start_admission(stream_of(spark, asked, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), limit).awaitTermination()
    got = {r.event_id: r.admitted for r in read_decisions(spark, str(tmp_path / "out")).collect()}
    assert got == {r.event_id: r.admitted for r in admission_replay(asked, limit).collect()}


def test_keyed_admission_restarts_and_survives_a_reset(spark, small, tmp_path):
    asked = catalog.requests(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "client", F.when(F.col("client") % 3 == 0, F.lit(None)).otherwise(F.col("client").cast("string")))
    limit, source, out = Limit(3, 86_400), str(tmp_path / "in"), str(tmp_path / "out")
    timed = asked.filter("ts IS NOT NULL")
    middle = timed.selectExpr("percentile_approx(unix_micros(ts), 0.5)").first()[0]
    halves = [asked.filter(F.coalesce(F.unix_micros("ts") <= middle, F.lit(True))), timed.filter(F.unix_micros("ts") > middle)]
    want = {(r.event_id, r.client, r.admitted) for r in admission_replay(asked, limit).collect()}

    def run(checkpoint):
        start_keyed_admission(stream_of(spark, asked, source), out, checkpoint, limit).awaitTermination()
        return read_decisions(spark, out)

    for half in halves:  # the second start goes on from the state the first one left
        half.coalesce(1).write.mode("append").parquet(source)
        found = run(str(tmp_path / "cp"))
    assert {(r.event_id, r.client, r.admitted) for r in found.collect()} == want and found.count() == asked.count()
    again = run(str(tmp_path / "other"))  # a checkpoint lost: decisions made before stay
    assert again.count() == 2 * asked.count() and again.select("writer").distinct().count() == 2
    assert {(r.event_id, r.client, r.admitted) for r in again.collect()} == want
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true") == "true"


def test_late_requests_are_decided_at_the_last_decision(spark, tmp_path):
    schema = "event_id long, client string, ts timestamp"
    hour = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    source = str(tmp_path / "in")
    for rows in ([(1, "a", hour(30)), (2, "a", hour(31))], [(3, "a", hour(1)), (4, "b", hour(1)), (5, "b", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    start_keyed_admission(live, str(tmp_path / "out"), str(tmp_path / "cp"), Limit(2, 86_400)).awaitTermination()
    found = {r.event_id: (r.decided_at, r.admitted) for r in read_decisions(spark, str(tmp_path / "out")).collect()}
    assert found == {1: (hour(30), True), 2: (hour(31), True), 3: (hour(31), False), 4: (hour(1), True), 5: (None, None)}


def test_live_admission_keeps_decisions_after_a_reset(spark, small, tmp_path):
    asked, out = catalog.requests(spark, small).limit(40), str(tmp_path / "out")
    files_of(asked, str(tmp_path / "in"), "event_id", 2)
    for checkpoint in ("cp", "other"):
        start_admission(stream_of(spark, asked, str(tmp_path / "in")), out, str(tmp_path / checkpoint), Limit(3, 86_400)).awaitTermination()
    found = read_decisions(spark, out)
    assert found.count() == 80 and found.select("event_id").distinct().count() == 40


def test_kept_report_needs_no_log(spark, small, tmp_path):
    events, path = catalog.usage_events(spark, small), str(tmp_path / "kept")
    halves = [events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")]
    for half in halves:
        files_of(half, str(tmp_path / "in"), "event_id", 2)
        start_usage_report(stream_of(spark, events, str(tmp_path / "in")), path, str(tmp_path / "cp")).awaitTermination()
    assert kept_summary(spark, path).first() == logs.usage_summary(events).first()
    counts = {r.route: r.requests for r in events.groupBy("route").agg(F.count("*").alias("requests")).collect()}
    assert {r.route: r.requests for r in kept_routes(spark, path).collect()} == counts
    assert spark.read.parquet(f"{path}/newest").count() <= 2 * logs.MAX_EVENTS  # the last two micro-batches
    # another stream's rows are counted next to these, and an event told twice is listed once
    start_usage_report(stream_of(spark, events, str(tmp_path / "in")), path, str(tmp_path / "other")).awaitTermination()
    assert kept_summary(spark, path).first() == logs.usage_summary(events).first()
    assert {r.route: r.requests for r in kept_routes(spark, path).collect()} == {k: 2 * v for k, v in counts.items()}


def test_an_upload_delivered_twice_is_stored_once(spark, small, tmp_path):
    docs = catalog.uploads(spark, small).filter("doc_id < 12").withColumn("upload_id", F.lit("u"))
    files_of(docs.unionByName(docs), str(tmp_path / "in"), "uploaded_at", 3)
    live = once_per_upload(stream_of(spark, docs, str(tmp_path / "in")), "100 days").drop("upload_id")
    start_ingest(live, str(tmp_path / "store"), str(tmp_path / "cp"), embedding.HashedTerms(16), buckets=4).awaitTermination()
    versions = store.read_versions(spark, str(tmp_path / "store"))
    want = embedded_documents(docs, embedding.HashedTerms(16)).select("doc_id").distinct().count()
    assert versions.count() == versions.select("doc_id").distinct().count() == want


def test_a_stream_of_rejected_files_leaves_a_readable_store(spark, small, tmp_path):
    path, model = str(tmp_path / "store"), embedding.HashedTerms(16)
    docs = catalog.uploads(spark, small)
    for number, part in enumerate((docs.filter("doc_id < 20").withColumn("text", F.lit(" ")), docs.filter("doc_id < 20"))):
        files_of(part, str(tmp_path / "in"), "doc_id", 1)
        start_ingest(stream_of(spark, docs, str(tmp_path / "in")), path, str(tmp_path / "cp"), model, buckets=4).awaitTermination()
        assert store.read_chunks(spark, path).isEmpty() == (number == 0)
        assert store.read_registry(spark, path).isEmpty() == (number == 0)


@pytest.mark.parametrize("query, table", [("ingest_stream", "documents"), ("usage_stream", "events"), ("request_windows", "events"), ("admission_stream", "events")])
def test_streamed_tables_may_be_folders(spark, small, tmp_path, query, table):
    """A larger table is a folder of files, not one file."""
    rows = spark.read.parquet(f"{small}/{table}.parquet")
    rows.filter(F.col(rows.columns[0]) < 100).repartition(2).write.parquet(str(tmp_path / "folder" / f"{table}.parquet"))
    (tmp_path / "file").mkdir()
    one = spark.read.parquet(str(tmp_path / "folder" / f"{table}.parquet")).toPandas()
    if "ts" in one:
        one["ts"] = one["ts"].astype("datetime64[us]")
    one.to_parquet(tmp_path / "file" / f"{table}.parquet")
    got, want = (catalog.QUERIES[query](spark, str(tmp_path / kind)).collect() for kind in ("folder", "file"))
    assert got and sorted(got) == sorted(want)


def test_a_first_delivery_is_never_too_late(spark, small, tmp_path):
    """Uploads that come far behind newer ones, and one without a time, are stored too, and once."""
    docs = catalog.uploads(spark, small).filter("doc_id < 40").withColumn("upload_id", F.lit("u")).withColumn("file_name", F.concat("doc_id", F.lit(".txt")))
    for first in range(30, -1, -10):  # newest first
        at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 1_000_000)
        some = docs.filter(F.col("doc_id").between(first, first + 9)).withColumn("uploaded_at", F.when(F.col("doc_id") != 35, at))
        some.unionByName(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = once_per_upload(stream_of(spark, docs, str(tmp_path / "in")), "1 day").drop("upload_id")
    start_ingest(live, str(tmp_path / "store"), str(tmp_path / "cp"), embedding.HashedTerms(16), buckets=4).awaitTermination()
    got = store.read_versions(spark, str(tmp_path / "store")).groupBy("doc_id").count().collect()
    want = embedded_documents(docs, embedding.HashedTerms(16)).select("doc_id").distinct().collect()
    assert sorted(got) == sorted((r.doc_id, 1) for r in want)


def test_micro_batches_do_not_grow_with_the_files(spark, small, tmp_path, monkeypatch):
    """Deliveries in many files are taken several at a time, but not all at once: what comes again later is still found."""
    spark.read.parquet(f"{small}/documents.parquet").repartition(12).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(catalog, "work_dir", lambda *_: str(tmp_path / "work"))
    got = catalog.ingest_once(spark, str(tmp_path / "in")).collect()
    files = [f for f in (tmp_path / "work" / "in").iterdir() if f.suffix == ".parquet"]
    taken = [f for f in (tmp_path / "work" / "store" / "documents").iterdir() if f.name.startswith("batch_id=")]
    assert len(files) > 8 and 2 <= len(taken) <= 5
    want = chunking.chunk_counts(chunking.chunk_text(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))).collect()
    assert sorted((r.doc_id, r.times, r.chunk_count) for r in got) == sorted((r.doc_id, 1, r.chunk_count) for r in want)
