"""Live admission with the rule's counters in Spark's state store, one state per client.

The counterpart of ``admission``, which runs the batch operator per micro-batch and
spreads a busy client over tasks. Here a client's requests of a micro-batch meet in one task with the
client's two counters, which Spark keeps, checkpoints with the query's
progress, and forgets after a time to live. What a task holds is the times and ids of one client's requests of a
micro-batch, 16 bytes each; the source's ``maxBytesPerTrigger`` bounds them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docquarry.operators.throttle import CHAT_LIMIT, Limit, micros
from docquarry.streaming.admission import decisions_folder
from docquarry.streaming.writers import writer_of

# of the query: where state lies, and no micro-batches without requests (a time to live would otherwise ask for them without end)
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_COUNTERS = "bucket long, previous long, current long, last_at long"


class Admission(StatefulProcessor):
    """The two-bucket rule for one client; its state are the counters after the last decision."""

    def __init__(self, limit: Limit, client_col: str, id_col: str, idle_seconds: int):
        self.limit, self.client_col, self.id_col, self.idle_seconds = limit, client_col, id_col, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", _COUNTERS, self.idle_seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.counters.get() if self.counters.exists() else None
        bucket, previous, current, last_at = known if known is not None else (None, 0, 0, None)
        parts = [(batch["at_micros"].to_numpy(np.int64), batch[self.id_col]) for batch in rows]
        ats, ids = np.concatenate([at for at, _ in parts]), pd.concat([names for _, names in parts], ignore_index=True)
        if last_at is not None:
            ats = np.maximum(ats, last_at)  # late requests are decided at the time of the last decision
        order = pd.DataFrame({"at": ats, "id": ids}).sort_values(["at", "id"], kind="stable").index.to_numpy()
        ats, ids = ats[order], ids.iloc[order]
        window, most = self.limit.window_micros, self.limit.requests
        admitted = np.zeros(len(ats), bool)
        for number, at in enumerate(ats.tolist()):
            now = at // window
            if now != bucket:
                previous = current if bucket is not None and now == bucket + 1 else 0
                bucket, current = now, 0
            share = 1.0 - (at % window) / float(window)
            if math.floor(share * previous) + current < most:
                admitted[number] = True
                current += 1
        self.counters.update((bucket, previous, current, int(ats[-1])))
        yield pd.DataFrame({"client_key": key[0], self.id_col: ids.to_numpy(), "at_micros": ats, "admitted": admitted})

    def close(self) -> None:
        pass


def decided(
    requests: DataFrame,
    limit: Limit = CHAT_LIMIT,
    client_col: str = "client",
    ts_col: str = "ts",
    id_col: str = "event_id",
    idle_seconds: int | None = None,
) -> DataFrame:
    """(client, id, decided_at, admitted) of streaming ``requests``, by the rule of ``admission_replay``.

    A client's counters are forgotten ``idle_seconds`` (two windows and ten minutes, by the clock) after
    its last request; time a query was stopped counts, so set it beyond planned stops.
    A request without a time stays undecided.
    """
    idle = 2 * limit.window_seconds + 600 if idle_seconds is None else idle_seconds
    schema = requests.schema
    named = requests.select(
        F.coalesce(F.concat(F.lit("="), F.col(client_col).cast("string")), F.lit("")).alias("client_key"), id_col, micros(F.col(ts_col)).alias("at_micros"))
    kept = f"client_key string, `{id_col}` {schema[id_col].dataType.simpleString()}, at_micros long, admitted boolean"
    found = named.filter("at_micros IS NOT NULL").groupBy("client_key").transformWithStateInPandas(
        Admission(limit, client_col, id_col, idle), kept, "append", "processingTime")
    found = found.unionByName(named.filter("at_micros IS NULL"), allowMissingColumns=True)
    client = F.when(F.col("client_key") != "", F.substring("client_key", 2, 2_000_000_000)).cast(schema[client_col].dataType)
    return found.select(client.alias(client_col), id_col, F.timestamp_micros("at_micros").alias("decided_at"), "admitted")


def start_keyed_admission(requests: DataFrame, path: str, checkpoint: str, limit: Limit = CHAT_LIMIT, trigger: dict | None = None, **options) -> StreamingQuery:
    """Write the decisions of streaming ``requests`` for ``admission.read_decisions``.

    A replayed micro-batch replaces its own decisions; those made before a checkpoint was reset stay.
    """
    spark = requests.sparkSession
    writer = writer_of(spark, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(decisions_folder(path, writer, batch_id))

    decisions = decided(requests, limit, **options).writeStream.outputMode("append").foreachBatch(write)
    # a query keeps the settings it was started with; the session gets its own back
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        return decisions.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
