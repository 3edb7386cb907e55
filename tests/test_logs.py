import datetime as dt

from pyspark.sql import functions as F

from docquarry.functions import labels
from docquarry.operators import logs
from docquarry.plans import catalog

EVENTS = "event_id long, route string, latency_ms double, ts timestamp"


def test_decode_drops_what_is_not_one_json_value(spark, medium):
    bad = ["bad", '"k": 69}', '{"k": 69', '{"k":69} x', "{'k':1}", "", "null", " null ", None]
    good = ['{"route":"chat","latencyMs":1.5,"timestamp":"t"}', ' {"route":"x"} ', '{"route":null}']
    log = spark.createDataFrame([(r,) for r in bad + good], "raw string")
    got = [tuple(r) for r in logs.decode_events(log).collect()]
    assert got == [("chat", 1.5, "t"), ("x", None, None), (None, None, None)]
    assert catalog.decode_usage(spark, medium).count() == 8_571


def test_summary_golden(spark, medium):
    kept = logs.newest(catalog.usage_events(spark, medium))
    assert tuple(logs.usage_totals(kept).first()) == (500, 50)
    routes = {r.route: r.requests for r in logs.usage_by_route(kept).collect()}
    assert routes == {"chat": 0, "upload": 0, "click": 100, "error": 100, "purchase": 99, "signup": 97, "view": 104}


def test_summary_of_nothing(spark):
    row = logs.usage_summary(spark.createDataFrame([], EVENTS)).first()
    assert row.total_requests == 0 and row.average_latency_ms == 0 and row.recent == []
    assert row.by_route == {"chat": 0, "upload": 0}


def test_summary_is_over_the_newest_500(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, None if i == 599 else "chat", float(i >= 100), base + dt.timedelta(seconds=i)) for i in range(600)]
    row = logs.usage_summary(spark.createDataFrame(rows, EVENTS)).first()
    assert (row.total_requests, row.average_latency_ms) == (500, 1)
    assert row.by_route == {"chat": 499, "upload": 0, "undefined": 1} and len(row.recent) == 20


def test_average_rounds_half_up_and_recent_is_newest_first(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "chat", float(i), base + dt.timedelta(seconds=i // 2)) for i in range(4)]
    row = logs.usage_summary(spark.createDataFrame(rows, EVENTS), limit=3).first()
    assert row.average_latency_ms == 2  # 1.5
    assert [e.latency_ms for e in row.recent] == [3.0, 2.0, 1.0]


def test_feedback_rules(spark):
    rows = [(1, "maybe", "q", "a"), (2, "up", "q", ""), (3, "up", "q", " "), (4, "down", None, "a"), (5, "down", "q", "a"),
            (6, None, "q", "a"), (7, "up", "", "a")]
    got = logs.accept_feedback(spark.createDataFrame(rows, "event_id long, vote string, question string, answer string"))
    assert sorted(r.event_id for r in got.collect()) == [3, 5]


def test_appending_a_batch_twice_is_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "chat", 1.0, dt.datetime(2024, 1, 1))], EVENTS)
    for batch in (0, 1, 1):
        logs.append_log(rows, str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_client_id(spark):
    values = [None, "", " , 2.2.2.2", "1.1.1.1, 2.2.2.2", "\t3.3.3.3 "]
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "h string").select(
        labels.client_id(F.col("h")).alias("c")).collect()]
    assert got == ["anonymous", "anonymous", "anonymous", "1.1.1.1", "3.3.3.3"]


def test_error_classes(spark):
    cases = [
        ("Missing OPENAI_API_KEY now", None, None, labels.MISSING_KEY_TEXT, 500),
        ("Missing GEMINI_API_KEY. Get one", None, None, "fallback", 500),
        ("quota exceeded", None, 429, labels.QUOTA_TEXT, 500),
        ("x", "rate_limit_exceeded", None, labels.RATE_LIMIT_TEXT, 429),
        ("x", None, 429, labels.RATE_LIMIT_TEXT, 429),
        ("INVALID API KEY and quota", None, None, labels.REJECTED_KEY_TEXT, 500),
        (None, "invalid_api_key", 429, labels.REJECTED_KEY_TEXT, 500),
        (None, None, 401, labels.REJECTED_KEY_TEXT, 500),
        (None, "insufficient_quota", None, labels.QUOTA_TEXT, 500),
        (None, None, None, "fallback", 500),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "message string, code string, status int")
    got = rows.select(labels.classify_error(F.col("message"), F.col("code"), F.col("status"), "fallback").alias("e")).collect()
    assert [(r.e.error, r.e.status) for r in got] == [c[3:] for c in cases]
