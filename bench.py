"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2, the faster run counts).
"""

from __future__ import annotations

import json
import os
import time

from docquarry.operators import retrieval
from docquarry.plans.catalog import QUERIES, vector_chunks
from docquarry.session import build_session, spread

HEADLINE = (
    "chunk_text", "chunk_pages", "merge_pages", "embed_hashed", "list_documents", "upsert_latest",
    "topk_all_documents", "topk_per_document", "scoped_topk", "build_prompt", "highlight_text", "message_list",
    "feedback_pairs", "export_markdown", "replay_answers", "decode_usage", "usage_summary",
    "throttle_flags", "admission_replay", "classify_errors",
)


def all_against_all(spark, sf):
    """Every stored vector as a question over all of them."""
    chunks = vector_chunks(spark, sf)
    asked = chunks.selectExpr("chunk_index AS query_id", "embedding")
    return retrieval.top_k(asked, spread(chunks))


def seconds(run, runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return best


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    plans = {name: QUERIES[name] for name in HEADLINE}
    plans["all_against_all"] = all_against_all
    times = {name: round(seconds(lambda: plan(spark, sf), runs), 3) for name, plan in plans.items()}
    chunks = QUERIES["chunk_text"](spark, sf).count()
    stored = vector_chunks(spark, sf).count()
    events = QUERIES["client_id"](spark, sf).count()
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf,
        "throughput": {
            "chunks_per_sec": round(chunks / times["chunk_text"]),
            "query_chunk_pairs_per_sec": round(stored * stored / times["all_against_all"]),
            "throttled_events_per_sec": round(events / times["throttle_flags"]),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
