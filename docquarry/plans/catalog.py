"""The registered queries: every operator, run over whole tables.

The tables stand for uploads, paged documents, chats, chunk vectors, questions
and request logs; the small functions at the top bind them to those roles.
``oracles.py`` says the same things in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import labels, vectors
from docquarry.functions.text import normalize_text
from docquarry.operators import chunking, conversations, embedding, highlights, logs, prompts, retrieval, throttle
from docquarry.plans import ask
from docquarry.plans.ingest import embedded_documents, embedded_pages
from docquarry.session import spread, work_dir
from docquarry.sources import store
from docquarry.sources.corpus import read_corpus, read_table, stream_corpus
from docquarry.sources.files import read_paged_files, write_texts
from docquarry.streaming.admission import read_decisions, start_admission
from docquarry.streaming.ingest import once_per_upload, start_ingest
from docquarry.streaming.keyed_admission import start_keyed_admission
from docquarry.streaming.usage import kept_routes, kept_summary, requests_per_window, start_usage_log, start_usage_report
from docquarry.streaming.writers import writer_of

PAGE_CHUNKS = {"chunk_size": 200, "overlap": 30}
HISTORY = 4
DAILY = throttle.Limit(3, 86_400)
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DELIVERED_BYTES = 512 << 20  # of files in a micro-batch


# --- the tables in their roles ------------------------------------------------

def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """documents with file names of several extensions and an upload time."""
    docs = read_table(spark, sf, "documents")
    endings = F.array(*[F.lit(e) for e in (".txt", ".MD", ".csv", ".pdf", ".docx", ".html", "")])
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"),
                    F.element_at(endings, (F.col("doc_id") % 7 + 1).cast("int")))
    uploaded = F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("doc_id") / 3) * 60)
    return docs.select("doc_id", name.alias("file_name"), "text", uploaded.alias("uploaded_at"))


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_text(spread(docs))


def paged(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as documents of pages."""
    talk = read_table(spark, sf, "conversations")
    return talk.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_pages(spread(paged(spark, sf)), **PAGE_CHUNKS)


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.chat_messages(read_table(spark, sf, "conversations"))


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as chunk vectors: label is the document, vec_id the chunk."""
    table = read_table(spark, sf, "embeddings")
    return table.select(
        F.col("label").cast("bigint").alias("doc_id"), F.col("vec_id").alias("chunk_index"), "embedding"
    )


def centroid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per document: the mean of its vectors, scoped to it."""
    entries = vector_chunks(spark, sf).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    means = entries.groupBy("doc_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])
    return means.groupBy("doc_id").agg(mean.alias("embedding")).select(
        F.col("doc_id").alias("query_id"), F.col("doc_id").alias("scope"), "embedding"
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    table = read_table(spark, sf, "benchmark")
    return table.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def question_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Best chunks of the whole documents table for each benchmark question."""
    return ask.find_sources_in_documents(questions(spark, sf), uploads(spark, sf))


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    table = read_table(spark, sf, "events")
    return table.select("event_id", F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), "ts")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), known_time().alias("ts"))


def known_time() -> F.Column:
    """The time of an event; every 97th has lost it."""
    return F.when(F.col("event_id") % 97 != 0, F.col("ts"))


def damaged_log(spark: SparkSession, sf: str) -> DataFrame:
    """events whose JSON has lost its first character in every seventh row."""
    raw = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return spread(read_table(spark, sf, "events").select("event_id", raw.alias("raw")))


def stream_log(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream that would have carried each assistant message.

    Records per message: sources, one delta per line, a record without a data
    line, and an error at the end of every answer with an even length.
    """
    told = spread(read_table(spark, sf, "conversations").filter(F.col("role") == "assistant"))
    request = F.concat_ws("-", "conv_id", "turn").alias("request_id")
    lines = F.split("text", "\n")

    def record(event, data):
        return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data)

    sources = F.to_json(F.struct(F.array(F.struct(F.col("turn").alias("index"))).alias("sources")))
    deltas = F.transform(
        lines,
        lambda line, at: record(
            F.lit("delta"),
            F.to_json(F.struct(F.when(at == 0, line).otherwise(F.concat(F.lit("\n"), line)).alias("delta"))),
        ),
    )
    ending = F.when(
        F.length("text") % 2 == 0, record(F.lit("error"), F.to_json(F.struct(F.lit("Chat request failed.").alias("error"))))
    ).otherwise(record(F.lit("done"), F.lit("{}")))
    records = F.concat(F.array(record(F.lit("sources"), sources)), deltas, F.array(F.lit("event: delta"), ending))
    return told.select(request, F.posexplode(records).alias("seq", "raw"))


def stamp(column: str) -> F.Column:
    return F.date_format(column, STAMP).alias(column)


# --- chunking and gates -------------------------------------------------------

def extension_gate(spark, sf):
    return chunking.extension_gate(uploads(spark, sf).select("doc_id", "file_name"))


def ingest_gate(spark, sf):
    files = uploads(spark, sf)
    number = F.col("doc_id")
    files = files.withColumn("file_name", F.when(number % 17 != 4, F.col("file_name"))).withColumn(
        "text", F.when(number % 11 == 3, F.lit(" \n\t")).when(number % 13 != 5, F.col("text"))
    )
    return chunking.ingest_gate(spread(files))


def normalize(spark, sf):
    rough = F.concat(F.lit("  \r\n"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n\t　"))
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", normalize_text(rough).alias("text"))


def chunk_text(spark, sf):
    return document_chunks(spark, sf).drop("page")


def chunk_counts(spark, sf):
    return chunking.chunk_counts(document_chunks(spark, sf))


def merge_pages(spark, sf):
    return chunking.merge_pages(paged(spark, sf))


# --- embedding and store ------------------------------------------------------

def embed_hashed(spark, sf):
    return embedding.nonzero_terms(embedding.embed(document_chunks(spark, sf)), ["doc_id", "chunk_index"]).withColumn(
        "weight", F.round("weight", 6)
    )


def attach_vectors(spark, sf):
    rows = vector_chunks(spark, sf)
    chunks = rows.select("doc_id", "chunk_index", F.concat(F.lit("chunk-"), F.col("chunk_index")).alias("chunk_id"))
    joined = embedding.attach_vectors(chunks, rows)
    return joined.select(
        "doc_id", "chunk_index", "chunk_id",
        F.size("embedding").cast("bigint").alias("dim"),
        F.round(vectors.norm(F.col("embedding")), 6).alias("length"),
    )


def _versions(spark, sf):
    """A first upload of every chunk, and a second of those whose vector starts
    above zero."""
    rows = vector_chunks(spark, sf)
    first = rows.select("doc_id", "chunk_index", F.lit("first").alias("text"), F.lit(0).cast("bigint").alias("batch_id"))
    again = rows.filter(F.col("embedding")[0] > 0).select(
        "doc_id", "chunk_index", F.lit("second").alias("text"), F.lit(2).cast("bigint").alias("batch_id")
    )
    return first.unionByName(again)


def upsert_latest(spark, sf):
    return store.latest_chunks(_versions(spark, sf))


def delete_documents(spark, sf):
    """Every third document is deleted between the two uploads."""
    gone = vector_chunks(spark, sf).select("doc_id").distinct().filter("doc_id % 3 = 0")
    tombstones = gone.select("doc_id", F.lit(1).cast("bigint").alias("batch_id"))
    return store.latest_chunks(store.without_deleted(_versions(spark, sf), tombstones))


def compact_store(spark, sf):
    """The same history through a written store: two uploads, a delete between
    them, then compaction into a new store and a read of that."""
    path = work_dir(spark, "store")
    rows = vector_chunks(spark, sf).withColumn("text", F.lit("first"))
    again = rows.filter(F.col("embedding")[0] > 0).withColumn("text", F.lit("second"))
    gone = rows.select("doc_id").distinct().filter("doc_id % 3 = 0")
    store.save_chunks(rows, f"{path}/old", 0, buckets=4, gather=True)
    store.delete_documents(gone, f"{path}/old", 1)
    store.save_chunks(again, f"{path}/old", 2, buckets=4, gather=True)
    store.compact(spark, f"{path}/old", f"{path}/new", 3, buckets=4)
    return store.read_chunks(spark, f"{path}/new").select(
        "doc_id", "chunk_index", "text", F.size("embedding").cast("bigint").alias("dim")
    )


def registry_after_delete(spark, sf):
    """Uploads in a written store, every fifth document deleted, every tenth of all uploaded again with a short text."""
    path = f"{work_dir(spark, 'registry')}/store"
    files = uploads(spark, sf)
    store.save_chunks(chunking.chunk_text(spread(files)), path, 0, buckets=4, gather=True)
    store.delete_documents(files.filter("doc_id % 5 = 0"), path, 1)
    again = files.filter("doc_id % 10 = 0").withColumn("text", F.lit("again"))
    store.save_chunks(chunking.chunk_text(again), path, 1, gather=True)
    return store.list_documents(store.read_registry(spark, path)).select("doc_id", "file_name", stamp("uploaded_at"), "chunk_count")


def paged_ingest(spark, sf):
    """Conversations as paged uploads through gate, chunks, vectors and store; every fourth has an unsupported name."""
    path = f"{work_dir(spark, 'paged')}/store"
    pages = paged(spark, sf)
    ending = F.when(F.col("doc_id") % 4 == 0, ".html").otherwise(".pdf")
    names = pages.select("doc_id").distinct().select(
        "doc_id", F.concat(F.lit("talk-"), F.col("doc_id").cast("string"), ending).alias("file_name"),
        F.timestamp_seconds(F.lit(1_704_067_200)).alias("uploaded_at"))
    store.save_chunks(embedded_pages(pages, names, buckets=8), path, 0, buckets=8)
    return store.read_chunks(spark, path).select("doc_id", "chunk_index", "page", "text", "file_name")


def list_documents(spark, sf):
    files = uploads(spark, sf)
    chunks = chunking.chunk_text(spread(files)).withColumn("batch_id", F.lit(0).cast("bigint"))
    listed = store.list_documents(store.registry(chunks))
    return listed.select("doc_id", "file_name", stamp("uploaded_at"), "chunk_count")


# --- retrieval ----------------------------------------------------------------

def cosine_scores(spark, sf):
    return retrieval.cosine_scores(centroid_queries(spark, sf), vector_chunks(spark, sf))


def topk_in_document(spark, sf):
    return retrieval.top_k_in_document(centroid_queries(spark, sf), vector_chunks(spark, sf))


def topk_all_documents(spark, sf):
    return retrieval.top_k(centroid_queries(spark, sf), vector_chunks(spark, sf))


def topk_per_document(spark, sf):
    return retrieval.top_k_per_document(centroid_queries(spark, sf), vector_chunks(spark, sf))


def scoped_topk(spark, sf):
    """Each centroid asked twice: in its document, and with a blank scope over
    the registered documents, two in three. A scope that names no document gets no hits."""
    asked = centroid_queries(spark, sf)
    inside = asked.select(F.concat(F.lit("in-"), "query_id").alias("query_id"),
                          F.concat(F.lit(" "), F.col("scope").cast("string")).alias("scope"), "embedding")
    everywhere = asked.select(F.concat(F.lit("all-"), "query_id").alias("query_id"), F.lit(" ").alias("scope"), "embedding")
    chunks = vector_chunks(spark, sf)
    registered = chunks.select("doc_id").distinct().filter("doc_id % 3 <> 0")
    nowhere = asked.select(F.concat(F.lit("no-"), "query_id").alias("query_id"), F.lit("no such document").alias("scope"), "embedding")
    return retrieval.scoped_top_k(inside.unionByName(everywhere).unionByName(nowhere), chunks, registered)


def answer_sources(spark, sf):
    return question_sources(spark, sf)


def sources_newest_first(spark, sf):
    """Sources among documents with exact copies: equal scores go to the newest upload."""
    chunks = embedding.embed(chunking.chunk_text(spread(uploads(spark, sf))))
    return ask.find_sources(questions(spark, sf), chunks, newest_col="uploaded_at")


# --- prompts and highlighting -------------------------------------------------

def citation_labels(spark, sf):
    """Pages count from 0 here, so each document's first page is 'absent'."""
    rows = page_chunks(spark, sf).withColumn("page", F.col("page") - 1)
    name = F.when(F.col("page") % 2 == 0, F.concat(F.lit("talk-"), F.col("doc_id").cast("string"))).otherwise(F.lit(""))
    return rows.select(
        "doc_id", "chunk_index",
        labels.prompt_location(F.col("page"), F.col("chunk_index")).alias("location"),
        labels.display_location(name, F.col("page"), F.col("chunk_index")).alias("label"),
        labels.display_score(F.length("text") / F.lit(777.0)).alias("score"),
    )


def build_context(spark, sf):
    return prompts.build_context(questions(spark, sf), question_sources(spark, sf))


def build_prompt(spark, sf):
    asked = questions(spark, sf)
    return prompts.build_prompt(asked, prompts.build_context(asked, question_sources(spark, sf)))


def store_prompts(spark, sf):
    """The whole way: gate, chunk, embed and store the uploads, then answer the
    questions from the store's registered documents."""
    path = f"{work_dir(spark, 'library')}/store"
    store.save_chunks(embedded_documents(uploads(spark, sf), buckets=8), path, 0, buckets=8)
    asked = questions(spark, sf).withColumn("scope", F.lit(None).cast("string"))
    return ask.prompts_for(asked, store.read_chunks(spark, path), store.read_registry(spark, path))


def history_window(spark, sf):
    talk = read_table(spark, sf, "conversations")
    return prompts.history_window(talk, HISTORY).select("conv_id", "turn", "role", "text")


def message_list(spark, sf):
    latest = conversations.latest_question(chats(spark, sf))
    prompt = F.concat(F.lit("Question:\n"), "question", F.lit("\n\nContext:\n"))
    history = prompts.history_window(read_table(spark, sf, "conversations"), HISTORY)
    return prompts.message_list(latest.select("conv_id", prompt.alias("prompt")), history)


def chat_messages(spark, sf):
    """A whole chat request: a question, its sources from the stored documents, the chat's last
    messages, and the message list to send. Question n is asked in chat n."""
    path = f"{work_dir(spark, 'chat')}/store"
    store.save_chunks(embedded_documents(uploads(spark, sf), buckets=8), path, 0, buckets=8)
    asked = questions(spark, sf).withColumn("scope", F.lit(" "))
    asked = ask.prompts_for(asked, store.read_chunks(spark, path), store.read_registry(spark, path), buckets=8)
    history = prompts.history_window(read_table(spark, sf, "conversations"), HISTORY)
    return prompts.message_list(asked.withColumnRenamed("query_id", "conv_id"), history)


def validate_questions(spark, sf):
    """Every message as a question; system texts stand in for blank ones."""
    talk = read_table(spark, sf, "conversations")
    question = F.when(F.col("role") == "system", F.lit(" \n")).otherwise(F.concat(F.lit("\t "), "text", F.lit(" ")))
    asked = talk.select("conv_id", "turn", question.alias("question"))
    registry = read_table(spark, sf, "documents").select("doc_id")
    return prompts.validate_questions(asked, registry)


def highlight_terms(spark, sf):
    terms = highlights.highlight_terms(F.col("question"))
    return questions(spark, sf).select("query_id", F.array_join(terms, " ").alias("terms"))


def highlight_text(spark, sf):
    terms = questions(spark, sf).select("query_id", highlights.highlight_terms(F.col("question")).alias("terms"))
    marked = highlights.highlight_text(F.col("text"), F.col("terms"))
    return question_sources(spark, sf).join(terms, "query_id").select("query_id", "rank", marked.alias("marked"))


# --- conversations ------------------------------------------------------------

def latest_question(spark, sf):
    return conversations.latest_question(chats(spark, sf))


def latest_sources(spark, sf):
    """Assistant messages carry one source per line of text; short ones none,
    and the shortest carry no value at all."""
    size = F.length("text")
    value = F.when(size % 3 == 0, F.array().cast("array<string>")).when(
        size % 3 == 1, F.filter(F.split("text", "\n"), lambda line: line != "")
    )
    talk = chats(spark, sf).withColumn("sources", F.when(F.col("role") == "assistant", value))
    return conversations.latest_sources(talk).select(
        "conv_id", F.size("sources").cast("bigint").alias("source_count"), F.array_join("sources", "|").alias("sources")
    )


def feedback_pairs(spark, sf):
    return conversations.feedback_pairs(chats(spark, sf))


def export_markdown(spark, sf):
    return conversations.export_markdown(chats(spark, sf))


def replay_answers(spark, sf):
    return conversations.replay_answers(stream_log(spark, sf))


def replay_requests(spark, sf):
    return conversations.replay_requests(stream_log(spark, sf))


# --- logs ---------------------------------------------------------------------

def usage_retained(spark, sf):
    return logs.newest(usage_events(spark, sf)).select("event_id", "route", "latency_ms", stamp("ts"))


def decode_usage(spark, sf):
    return logs.decode_events(damaged_log(spark, sf), schema="k BIGINT", keep=("event_id",))


def _as_text(report: DataFrame) -> DataFrame:
    routes = F.transform(F.map_entries("by_route"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    recent = F.transform("recent", lambda e: F.concat_ws("@", e["route"], F.date_format(e["ts"], STAMP)))
    return report.select(
        "total_requests", "average_latency_ms",
        F.array_join(F.array_sort(routes), ",").alias("by_route"),
        F.array_join(recent, ",").alias("recent"),
    )


def usage_summary(spark, sf):
    return _as_text(logs.usage_summary(usage_events(spark, sf)))


def usage_from_outcomes(spark, sf):
    """The newest usage events of all chat requests that did not fail and all uploads that were stored."""
    def at(number):
        return F.timestamp_seconds(F.lit(1_704_067_200) + number).alias("ts")

    asked = replay_requests(spark, sf).select("request_id", "failed", (F.col("deltas") * 10).alias("latency_ms"), at(F.col("deltas")))
    sent = ingest_gate(spark, sf).select("doc_id", "status", (F.col("chunk_count") * 5).alias("latency_ms"), at(F.col("doc_id")))
    logged = logs.successes(asked, "chat", ~F.col("failed"), "request_id").unionByName(logs.successes(sent, "upload", F.col("status") == "ready", "doc_id"))
    return logs.newest(logged).select("event_id", "route", "latency_ms", stamp("ts"))


def usage_by_route(spark, sf):
    return logs.usage_by_route(logs.newest(usage_events(spark, sf)))


def usage_recent(spark, sf):
    recent = logs.usage_recent(logs.newest(usage_events(spark, sf)))
    return recent.select("event_id", "route", "latency_ms", stamp("ts"))


def feedback_retained(spark, sf):
    """Every answer with its question as feedback; votes and gaps follow from
    the lengths of the texts."""
    pairs = conversations.feedback_pairs(chats(spark, sf))
    size = F.length("answer")
    submitted = pairs.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"),
        F.when(size % 5 == 0, "maybe").when(size % 2 == 0, "up").otherwise("down").alias("vote"),
        "question",
        F.when(size % 7 == 0, "").when(size % 7 == 1, " ").otherwise(F.col("answer")).alias("answer"),
        F.when(size % 3 != 0, F.col("conv_id")).alias("doc_id"),
        F.col("conv_id").alias("ts"),
    )
    return logs.newest(logs.accept_feedback(submitted)).select("event_id", "vote", "question", "answer", "doc_id")


def client_id(spark, sf):
    number = F.col("user_id").cast("string")
    header = (
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit(" , "), number))
        .when(F.col("user_id") % 5 == 1, "")
        .when(F.col("user_id") % 5 != 2, F.concat(F.lit(" 10.0.0."), number, F.lit(" , 10.1.1.1")))
    )
    return read_table(spark, sf, "events").select("event_id", labels.client_id(header).alias("client"))


def classify_errors(spark, sf):
    """Request events as failures: messages, codes and statuses from their fields."""
    number = F.col("event_id")
    messages = ["Missing OPENAI_API_KEY", "Missing GEMINI_API_KEY", "Incorrect API key provided",
                "You exceeded your current QUOTA", "billing hard limit", "socket closed"]
    codes = ["invalid_api_key", "insufficient_quota", "rate_limit_exceeded", "", None]
    statuses = [401, 429, 500, None]

    def pick(values, by, kind):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (by % len(values) + 1).cast("int"))

    failed = read_table(spark, sf, "events").select(
        "event_id",
        pick(messages, number, "string").alias("message"),
        pick(codes, F.floor(number / 6), "string").alias("code"),
        pick(statuses, F.floor(number / 30), "int").alias("status"),
    )
    answer = labels.classify_error(F.col("message"), F.col("code"), F.col("status"), "Chat request failed.")
    return failed.select("event_id", answer.alias("answer")).select("event_id", "answer.error", "answer.status")


# --- throttling ---------------------------------------------------------------

def throttle_flags(spark, sf):
    flagged = throttle.throttle_flags(requests(spark, sf), DAILY)
    return flagged.select("event_id", "client", stamp("ts"), "attempts", "throttled")


def admission_replay(spark, sf):
    return throttle.admission_replay(requests(spark, sf), DAILY).select("event_id", "client", stamp("decided_at"), "admitted")


# --- streams ------------------------------------------------------------------

def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files; only a pattern may name either."""
    schema = read_table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")


def _in_stretches(rows: DataFrame, ts_col: str, count: int, path: str) -> DataFrame:
    """``rows`` written stretch by stretch of time below ``path``, as a stream that takes one stretch after the other."""
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [i / count for i in range(1, count)])).first()[0] or []
    number = sum([(F.coalesce(at, F.lit(0)) > cut).cast("int") for cut in cuts], F.lit(0))
    for stretch in range(count):
        rows.filter(number == stretch).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _in_deliveries(spark: SparkSession, schema, path: str, least: int = 4) -> DataFrame:
    """The files below ``path`` as a stream, in about ``least`` micro-batches or as many as keep each at ``DELIVERED_BYTES``.

    A micro-batch has a cost of its own and goes through all keys kept: one per file would make the time grow with the files times the keys.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    each = -(-files // max(least, -(-size // DELIVERED_BYTES)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, each)).parquet(path)


def ingest_stream(spark, sf):
    """The documents table through the streaming ingest; what the store lists."""
    path = work_dir(spark, "ingest")
    docs = _stream(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text",
        F.timestamp_seconds(F.lit(1_704_067_200)).alias("uploaded_at"),
    )
    start_ingest(docs, f"{path}/store", f"{path}/checkpoint", buckets=8).awaitTermination()
    listed = store.registry(store.read_chunks(spark, f"{path}/store"))
    return listed.select("doc_id", "file_name", "chunk_count")


def usage_stream(spark, sf):
    """The events table through the live usage log; its report."""
    path = work_dir(spark, "usage")
    events = _stream(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), "ts"
    )
    start_usage_log(events, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    kept = logs.newest(spark.read.parquet(f"{path}/log"))
    return logs.usage_totals(kept)


def request_windows(spark, sf):
    """Requests per day and route as a stream; the latest count of each window, open or closed."""
    path = work_dir(spark, "windows")
    events = _stream(spark, sf, "events").select(F.col("event_type").alias("route"), "ts")
    counted = requests_per_window(events, "1 day", "1 hour")
    writer = writer_of(spark, f"{path}/checkpoint")
    (
        counted.writeStream.outputMode("update").foreachBatch(lambda batch, number: logs.append_log(batch, f"{path}/out", number, writer))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    out = spark.read.parquet(f"{path}/out").groupBy("window_start", "route").agg(F.max_by("requests", "batch_id").alias("requests"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "route", "requests")


def admission_stream(spark, sf):
    """The requests through the live admission rule."""
    path = work_dir(spark, "admission")
    asked = _stream(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), known_time().alias("ts"))
    start_admission(asked, f"{path}/out", f"{path}/checkpoint", DAILY).awaitTermination()
    return read_decisions(spark, f"{path}/out").select("event_id", "client", stamp("decided_at"), "admitted")


def usage_incremental(spark, sf):
    """The events in four stretches of time, one per micro-batch, through the kept report."""
    path = work_dir(spark, "usage-report")
    live = _in_stretches(usage_events(spark, sf), "ts", 4, f"{path}/in")
    start_usage_report(live, f"{path}/kept", f"{path}/checkpoint").awaitTermination()
    return _as_text(kept_summary(spark, f"{path}/kept"))


def usage_routes_incremental(spark, sf):
    """The same stream's counts of all events by route."""
    path = work_dir(spark, "usage-routes")
    live = _in_stretches(usage_events(spark, sf), "ts", 4, f"{path}/in")
    start_usage_report(live, f"{path}/kept", f"{path}/checkpoint").awaitTermination()
    return kept_routes(spark, f"{path}/kept")


def ingest_once(spark, sf):
    """A stream of uploads of which every third is delivered twice: how often each was stored, and its chunks."""
    path = work_dir(spark, "once")
    files = uploads(spark, sf).withColumn("file_name", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = files.withColumn("upload_id", F.col("doc_id").cast("string"))
    files.filter("doc_id % 2 = 0 OR doc_id % 3 = 0").write.mode("append").parquet(f"{path}/in")
    files.filter("doc_id % 2 <> 0 OR doc_id % 3 = 0").write.mode("append").parquet(f"{path}/in")
    live = _in_deliveries(spark, files.schema, f"{path}/in")
    start_ingest(once_per_upload(live, "100 days").drop("upload_id"), f"{path}/store", f"{path}/checkpoint", buckets=8).awaitTermination()
    stored = store.read_versions(spark, f"{path}/store")
    return stored.groupBy("doc_id", "file_name").agg(F.count("*").alias("times"), F.sum("chunk_count").alias("chunk_count"))


# --- files ----------------------------------------------------------------------

def corpus_files(spark, sf):
    """Texts of documents as files, taken up as a stream of files into a store; what it lists."""
    path = work_dir(spark, "files")
    docs = read_table(spark, sf, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".html").otherwise(".txt"))
    write_texts(docs.select(name.alias("name"), F.lit(0).alias("part"), "text"), f"{path}/in")
    files = stream_corpus(spark, f"{path}/in", "upload", journal=f"{path}/journal")
    start_ingest(files, f"{path}/store", f"{path}/checkpoint", buckets=8).awaitTermination()
    return store.read_registry(spark, f"{path}/store").select("file_name", "chunk_count")


def paged_files(spark, sf):
    """Conversations as files with a form feed between their pages, read as pages and chunked."""
    path = work_dir(spark, "paged-files")
    pages = paged(spark, sf)
    text = F.concat(F.when(F.col("page") > 1, F.lit("\f")).otherwise(""), F.coalesce("text", F.lit("")))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    write_texts(pages.select(name.alias("name"), F.col("page").alias("part"), text.alias("text")), path)
    read = read_paged_files(spark, path).withColumn("doc_id", F.split_part("file_name", F.lit("."), F.lit(1)).cast("bigint"))
    return chunking.chunk_pages(read.select("doc_id", "page", "text"), **PAGE_CHUNKS)


def export_files(spark, sf):
    """The exported chats as files, read back."""
    path = work_dir(spark, "exports")
    conversations.write_markdown(conversations.export_markdown(chats(spark, sf)), path)
    files = read_corpus(spark, path).filter(F.col("file_name").like("%.md"))
    chat = F.regexp_extract("file_name", r"^conversation-(\d+)\.md$", 1).cast("bigint")
    return files.select(chat.alias("conv_id"), F.lit(0).cast("bigint").alias("part"), F.col("text").alias("markdown"))


def admission_state_stream(spark, sf):
    """The requests in four stretches of time, one per micro-batch, through the live rule with state kept by Spark."""
    path = work_dir(spark, "keyed-admission")
    live = _in_stretches(requests(spark, sf), "ts", 4, f"{path}/in")
    start_keyed_admission(live, f"{path}/out", f"{path}/checkpoint", DAILY).awaitTermination()
    return read_decisions(spark, f"{path}/out").select("event_id", "client", stamp("decided_at"), "admitted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extension_gate": extension_gate,
    "ingest_gate": ingest_gate,
    "normalize_text": normalize,
    "chunk_text": chunk_text,
    "chunk_pages": page_chunks,
    "merge_pages": merge_pages,
    "chunk_counts": chunk_counts,
    "embed_hashed": embed_hashed,
    "attach_vectors": attach_vectors,
    "upsert_latest": upsert_latest,
    "list_documents": list_documents,
    "registry_after_delete": registry_after_delete,
    "paged_ingest": paged_ingest,
    "delete_documents": delete_documents,
    "compact_store": compact_store,
    "cosine_scores": cosine_scores,
    "topk_in_document": topk_in_document,
    "topk_all_documents": topk_all_documents,
    "topk_per_document": topk_per_document,
    "scoped_topk": scoped_topk,
    "answer_sources": answer_sources,
    "sources_newest_first": sources_newest_first,
    "citation_labels": citation_labels,
    "build_context": build_context,
    "build_prompt": build_prompt,
    "store_prompts": store_prompts,
    "history_window": history_window,
    "message_list": message_list,
    "chat_messages": chat_messages,
    "validate_questions": validate_questions,
    "highlight_terms": highlight_terms,
    "highlight_text": highlight_text,
    "latest_question": latest_question,
    "latest_sources": latest_sources,
    "feedback_pairs": feedback_pairs,
    "export_markdown": export_markdown,
    "replay_answers": replay_answers,
    "replay_requests": replay_requests,
    "usage_retained": usage_retained,
    "decode_usage": decode_usage,
    "usage_summary": usage_summary,
    "usage_by_route": usage_by_route,
    "usage_from_outcomes": usage_from_outcomes,
    "usage_recent": usage_recent,
    "feedback_retained": feedback_retained,
    "client_id": client_id,
    "throttle_flags": throttle_flags,
    "admission_replay": admission_replay,
    "classify_errors": classify_errors,
    "ingest_stream": ingest_stream,
    "usage_stream": usage_stream,
    "request_windows": request_windows,
    "admission_stream": admission_stream,
    "admission_state_stream": admission_state_stream,
    "usage_incremental": usage_incremental,
    "usage_routes_incremental": usage_routes_incremental,
    "ingest_once": ingest_once,
    "corpus_files": corpus_files,
    "paged_files": paged_files,
    "export_files": export_files,
}
