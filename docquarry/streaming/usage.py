"""Live usage log: append events as they come, report over the newest 500."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.logs import MAX_EVENTS, append_log, newest, usage_summary
from docquarry.streaming.writers import writer_of


def start_usage_log(events: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append streaming ``events(event_id, route, latency_ms, ts)`` to the log."""
    writer = writer_of(events.sparkSession, checkpoint)
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: append_log(batch, log_path, batch_id, writer))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_summary(spark: SparkSession, log_path: str) -> DataFrame:
    """The report as of now."""
    return usage_summary(spark.read.parquet(log_path))


def start_usage_report(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, limit: int = MAX_EVENTS) -> StreamingQuery:
    """Keep the newest ``limit`` events, and counts by route of all events, of a stream in two small tables.

    Each micro-batch merges its own newest events and counts into those of the one before; the tables of the last
    two stay, in turn, so that a replayed micro-batch starts from the same rows. No log is kept or read.
    """
    spark = events.sparkSession
    writer = writer_of(spark, checkpoint)
    tables = {"newest": events.schema, "routes": "route string, requests bigint"}

    def place(table: str, batch_id: int) -> str:
        return f"{path}/{table}/writer={writer}/slot={batch_id % 2}"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = {"newest": newest(batch, limit), "routes": batch.groupBy("route").agg(F.count("*").alias("requests"))}
        if batch_id > 0:
            own = {name: rows.unionByName(spark.read.schema(tables[name]).parquet(place(name, batch_id - 1))) for name, rows in own.items()}
        merged = {"newest": newest(own["newest"], limit), "routes": own["routes"].groupBy("route").agg(F.sum("requests").alias("requests"))}
        for name, rows in merged.items():
            rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(place(name, batch_id))

    return (
        events.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _latest(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Each writer's rows of its last micro-batch: a few hundred rows a writer."""
    rows = spark.read.parquet(f"{path}/{table}")
    last = rows.groupBy("writer").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(F.broadcast(last), ["writer", "batch_id"]).drop("writer", "batch_id", "slot")


def kept_summary(spark: SparkSession, path: str) -> DataFrame:
    """The report over what ``start_usage_report`` keeps, an event told by two writers once."""
    return usage_summary(_latest(spark, path, "newest").dropDuplicates(["event_id"]))


def kept_routes(spark: SparkSession, path: str) -> DataFrame:
    """(route, requests) of all events seen, by all writers together."""
    return _latest(spark, path, "routes").groupBy("route").agg(F.sum("requests").alias("requests"))


def requests_per_window(events: DataFrame, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Streaming request counts by event-time window and route.

    Counts are partial per task before the shuffle; rows later than
    ``lateness`` no longer change a closed window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window), "route").agg(F.count("*").alias("requests")).select(
        F.col("window.start").alias("window_start"), "route", "requests"
    )
