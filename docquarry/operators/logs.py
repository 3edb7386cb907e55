"""Usage and feedback logs: tolerant decode, retention, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.json import is_json_record

# Retained events, listed events, always-listed routes, votes.
MAX_EVENTS = 500
RECENT_EVENTS = 20
ROUTES = ("chat", "upload")
VOTES = ("up", "down")

USAGE_SCHEMA = "route STRING, latencyMs DOUBLE, timestamp STRING"


def decode_events(log: DataFrame, raw_col: str = "raw", schema: str = USAGE_SCHEMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode a JSON log; rows that are not exactly one JSON value are dropped.

    Fields missing from a valid record stay null.
    """
    event = F.from_json(F.col(raw_col), schema)
    return log.filter(is_json_record(F.col(raw_col))).select(*keep, event.alias("_event")).select(*keep, "_event.*")


def newest(events: DataFrame, limit: int = MAX_EVENTS, ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The retained tail of a log: each task keeps ``limit`` rows, then a merge."""
    return events.orderBy(F.desc(ts_col), F.desc(id_col)).limit(limit)


def usage_totals(events: DataFrame, *more: Column) -> DataFrame:
    """(total_requests, average_latency_ms) over the given events; 0, 0 if none.

    The average is rounded half up. Events without a latency do not count
    towards it.
    """
    return events.agg(
        F.count("*").alias("total_requests"),
        F.coalesce(F.floor(F.avg("latency_ms") + F.lit(0.5)), F.lit(0)).cast("bigint").alias("average_latency_ms"),
        *more,
    )


def usage_by_route(events: DataFrame) -> DataFrame:
    """(route, requests): the two known routes always, others as they occur;
    events without a route are listed as ``undefined``."""
    known = events.sparkSession.createDataFrame([(route,) for route in ROUTES], "route STRING")
    zeros = known.select("route", F.lit(0).cast("bigint").alias("requests"))
    route = F.coalesce("route", F.lit("undefined")).alias("route")
    counted = events.groupBy(route).agg(F.count("*").alias("requests"))
    return counted.unionByName(zeros).groupBy("route").agg(F.sum("requests").alias("requests"))


def usage_recent(events: DataFrame, limit: int = RECENT_EVENTS) -> DataFrame:
    return newest(events, limit)


def usage_summary(events: DataFrame, limit: int = RECENT_EVENTS) -> DataFrame:
    """The whole report over the newest 500 events, as one row.

    (total_requests, by_route MAP, average_latency_ms, recent ARRAY<STRUCT>)

    The retained events are few, so one array of them serves the whole report
    and the log is read once.
    """
    route = F.coalesce("route", F.lit("undefined")).alias("route")
    row = F.struct("ts", "event_id", route, "latency_ms")
    totals = usage_totals(newest(events), F.reverse(F.array_sort(F.collect_list(row))).alias("_events"))
    routes = F.transform("_events", lambda e: e["route"])
    names = F.array_distinct(F.concat(F.array(*[F.lit(route) for route in ROUTES]), routes))
    counts = F.transform(
        names, lambda name: F.struct(name, F.size(F.filter(routes, lambda other: other == name)).cast("bigint"))
    )
    recent = F.transform(
        F.slice("_events", 1, limit),
        lambda e: F.struct(e["route"].alias("route"), e["latency_ms"].alias("latency_ms"), e["ts"].alias("ts")),
    )
    return totals.select(
        "total_requests", F.map_from_entries(counts).alias("by_route"), "average_latency_ms", recent.alias("recent")
    )


def accept_feedback(submitted: DataFrame) -> DataFrame:
    """Votes up or down with a question and an answer; spaces alone count as
    text, and a missing document id stays null."""
    given = (F.col("question") != "") & (F.col("answer") != "")
    return submitted.filter(F.col("vote").isin(*VOTES) & given)


def successes(outcomes: DataFrame, route: str, succeeded: Column, id_col: str = "event_id") -> DataFrame:
    """Usage events (event_id, route, latency_ms, ts) of the requests that succeeded; failed ones, and those whose outcome is unknown, are not logged."""
    logged = outcomes.filter(F.coalesce(succeeded, F.lit(False)))
    return logged.select(F.col(id_col).cast("string").alias("event_id"), F.lit(route).alias("route"), F.col("latency_ms").cast("double").alias("latency_ms"), "ts")


def append_log(events: DataFrame, path: str, batch_id: int, writer: str = "batch") -> None:
    """Append one batch of a writer; writing the same batch again replaces it, and no other writer's."""
    events.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch_id={batch_id}")
