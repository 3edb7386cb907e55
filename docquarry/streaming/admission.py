"""Live admission: the two-bucket rule applied to a stream of requests.

Each micro-batch runs the batch operator from the state the last one left, so
a busy client is spread over tasks here as well. State is a small Parquet
table per batch - clients seen in about the last two windows - next to the decisions.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.throttle import CHAT_LIMIT, Limit, admission_replay, drop_idle, state_after
from docquarry.streaming.writers import writer_of


def _folder(path: str, kind: str, writer: str, batch_id: int) -> str:
    return f"{path}/{kind}/writer={writer}/batch_id={batch_id}"


def decisions_folder(path: str, writer: str, batch_id: int) -> str:
    return _folder(path, "decisions", writer, batch_id)


def start_admission(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    limit: Limit = CHAT_LIMIT,
    client_col: str = "client",
    ts_col: str = "ts",
    id_col: str = "event_id",
    trigger: dict | None = None,
    lateness_seconds: int = 600,
) -> StreamingQuery:
    """Write decisions (client, id, decided_at, admitted, and counts) for streaming ``requests``.

    Batch n reads the state written by batch n - 1 and overwrites its own
    folders, so a replayed batch decides the same again. Folders carry the checkpoint's writer id: after
    a checkpoint was reset, decisions made before stay, next to those of the new start. A client's state goes when it was idle for two
    windows and ``lateness_seconds`` while this query ran; time the query was stopped does not count.
    """
    started = time.time()
    idle = 2 * limit.window_seconds + lateness_seconds
    writer = writer_of(requests.sparkSession, checkpoint)

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(_folder(path, "state", writer, batch_id - 1)) if batch_id > 0 else None
        decided = decisions_folder(path, writer, batch_id)
        admission_replay(batch, limit, client_col, ts_col, id_col, state).write.mode("overwrite").parquet(decided)
        now = time.time()
        after = state_after(spark.read.parquet(decided), state, client_col, id_col, F.lit(now))
        since = now - idle if now - idle > started else 0.0
        drop_idle(after, F.lit(since)).write.mode("overwrite").parquet(_folder(path, "state", writer, batch_id))

    return (
        requests.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """All decisions, with the ``writer`` that made them: one for each checkpoint."""
    return spark.read.parquet(f"{path}/decisions").drop("batch_id")
