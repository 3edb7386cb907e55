"""Request throttling over logs: trailing-window flags and admission replay.

Both are running values per client. Ordinary clients take one shuffle by
client. Clients behind one address, or all anonymous ones, can make up most of
a log; such large clients are found first and cut into stretches of time, so
that no task has to take a whole one (see ``scans``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators.scans import LARGE_KEY_ROWS, block_among, by_block, large_keys, running_total


@dataclass(frozen=True)
class Limit:
    requests: int
    window_seconds: int

    @property
    def window_micros(self) -> int:
        return self.window_seconds * 1_000_000


# 20 chats per minute, 10 uploads per 5 minutes.
CHAT_LIMIT = Limit(20, 60)
UPLOAD_LIMIT = Limit(10, 300)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def throttle_flags(
    requests: DataFrame,
    limit: Limit = CHAT_LIMIT,
    client_col: str = "client",
    ts_col: str = "ts",
    id_col: str = "event_id",
    large_key_rows: int = LARGE_KEY_ROWS,
) -> DataFrame:
    """Add ``attempts`` (this client's attempts in the trailing window, this
    moment included, both ends closed) and ``throttled`` (over the limit).
    A request without a time stays, with both null.

    Every attempt adds 1 when made and takes 1 away once the window has passed,
    so the count is one running total over both kinds of rows. (A sliding
    RANGE frame would add up the whole window again for every row.)
    """
    at = micros(F.col(ts_col))
    # An attempt exactly one window old still counts: it leaves just after.
    steps = F.array(
        F.struct(at.alias("_at"), F.lit(1).cast("bigint").alias("_step")),
        F.struct((at + F.lit(limit.window_micros + 1)).alias("_at"), F.lit(-1).cast("bigint").alias("_step")),
    )
    large = large_keys(requests, [client_col], at, large_key_rows)
    steps = requests.select(client_col, ts_col, id_col, F.inline(steps))
    counted = running_total(steps, [client_col], ["_at"], F.col("_step"), "attempts", F.col("_at"), large)
    attempts = F.when(F.col("_at").isNotNull(), F.col("attempts"))
    return counted.filter(F.col("_step") == 1).select(
        client_col, ts_col, id_col, attempts.alias("attempts"), (attempts > limit.requests).alias("throttled")
    )


def _whole_clients(df: DataFrame, client_col: str) -> DataFrame:
    """Bring each client into one partition, by an expression of its own.

    Repartitioning a union by the column itself may be dropped when both sides
    are already partitioned by it, and partitions merged at run time may then
    separate a client's rows: mapInPandas asks for no partitioning.
    """
    return df.repartition(F.xxhash64(client_col))


def _decide_in_order(limit: Limit, client_col: str):
    """The rule applied to partitions sorted by client and time.

    The state to keep is one client's, so memory does not grow with the log.
    Rows of kind 0 carry a state in.
    """
    window = limit.window_micros

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket, previous, current = None, None, 0, 0
        for batch in batches:
            ats = batch["_at"].to_numpy()
            buckets, shares = ats // window, 1.0 - (ats % window) / float(window)
            rows = zip(batch[client_col].tolist(), batch["_kind"].tolist(), buckets.tolist(), shares.tolist(),
                       batch["_previous"].tolist(), batch["_current"].tolist())
            counts, before, admitted = [], [], []
            for row_client, kind, row_bucket, share, old_previous, old_current in rows:
                if row_client != client:
                    client, bucket, previous, current = row_client, None, 0, 0
                if kind == 0:
                    bucket, previous, current = row_bucket, old_previous, old_current
                elif row_bucket != bucket:
                    previous = current if bucket is not None and row_bucket == bucket + 1 else 0
                    bucket, current = row_bucket, 0
                ok = kind == 1 and math.floor(share * previous) + current < limit.requests
                current += ok
                admitted.append(ok)
                before.append(previous)
                counts.append(current)
            yield batch.assign(_bucket=buckets, _previous=before, _current=counts, admitted=admitted)

    return decide


def _replay_in_order(slim: DataFrame, limit: Limit, client_col: str, id_col: str, state: DataFrame | None) -> DataFrame:
    """Decisions for clients of ordinary size: one shuffle by client."""
    nothing = F.lit(0).cast("bigint")
    rows = slim.select(client_col, id_col, "_at", F.lit(1).alias("_kind"), nothing.alias("_previous"), nothing.alias("_current"))
    if state is not None:
        rows = rows.unionByName(
            state.select(client_col, F.lit(None).cast(slim.schema[id_col].dataType).alias(id_col),
                         F.col("last_at").alias("_at"), F.lit(0).alias("_kind"),
                         F.col("previous").alias("_previous"), F.col("current").alias("_current"))
        )
    ordered = _whole_clients(rows, client_col).sortWithinPartitions(client_col, "_kind", "_at", id_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("_bucket", T.LongType()), T.StructField("admitted", T.BooleanType())])
    return ordered.mapInPandas(_decide_in_order(limit, client_col), schema).filter("_kind = 1").drop("_kind")


def _allowance(previous: Column, elapsed: Column, limit: Limit) -> Column:
    """Requests the window allows at this moment, counting the previous
    bucket's admissions by the share of it that the window still covers."""
    share = F.lit(1.0) - elapsed / F.lit(float(limit.window_micros))
    return F.lit(limit.requests) - F.floor(share * previous)


def _slot_results(placed: DataFrame, limit: Limit, client_col: str) -> DataFrame:
    """What a slot does to the admitted count, whatever came before it.

    With ``n`` attempts, a count of c on entry becomes
    ``min(c + n, ceiling[previous])``; all values lie in 0..limit.
    """
    ceilings = [
        F.min(_allowance(F.lit(p), F.col("_elapsed"), limit) - F.col("_place")) + F.max("_place")
        for p in range(limit.requests + 1)
    ]
    return placed.groupBy(client_col, "_bucket", "_slot").agg(
        F.least(F.max("_place"), F.lit(limit.requests)).cast("int").alias("_n"),
        F.array(*[c.cast("int") for c in ceilings]).alias("_ceilings"),
    )


def _follow_slots(client_col: str):
    """Walk each client's slots in order, in partitions sorted that way."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket, previous, current = None, None, 0, 0
        for batch in batches:
            before, start = [], []
            rows = zip(batch[client_col].tolist(), batch["_bucket"].tolist(), batch["_slot"].tolist(),
                       batch["_n"].tolist(), batch["_ceilings"])
            for row_client, row_bucket, slot, n, ceilings in rows:
                if row_client != client:
                    client, bucket, previous, current = row_client, None, 0, 0
                if slot < 0:  # a state carried in: (current, [previous])
                    bucket, previous, current = row_bucket, int(ceilings[0]), int(n)
                elif row_bucket != bucket:
                    previous = current if bucket is not None and row_bucket == bucket + 1 else 0
                    bucket, current = row_bucket, 0
                before.append(previous)
                start.append(current)
                if slot >= 0:
                    current = min(current + int(n), int(ceilings[previous]))
            yield batch[[client_col, "_bucket", "_slot"]].assign(_previous=before, _start=start)

    return follow


def _replay_by_slots(
    slim: DataFrame, limit: Limit, client_col: str, id_col: str, state: DataFrame | None, large: DataFrame
) -> DataFrame:
    """Decisions for large clients, whose requests go to many tasks.

    Within a bucket the allowance never falls, so after the i-th attempt of a
    slot the count is ``min(start + i, min over j <= i of allowance_j + i - j)``,
    a running minimum. A slot thus acts on the count in a way that a short
    table sums up (``_slot_results``); only those tables are walked in order.
    """
    keys = [client_col, "_bucket", "_slot"]
    bucket = F.floor(F.col("_at") / F.lit(limit.window_micros)).cast("bigint")
    slotted = (
        slim.join(F.broadcast(large), client_col)
        .withColumn("_bucket", bucket)
        .withColumn("_elapsed", F.col("_at") - F.col("_bucket") * F.lit(limit.window_micros))
        .withColumn("_slot", block_among(F.col("_at"), F.col("_cuts")))
        .drop("_cuts")
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", id_col)).cast("bigint")
    placed = by_block(slotted, keys[:2], "_slot").withColumn("_place", place)
    slots = _slot_results(placed, limit, client_col)
    if state is not None:
        slots = slots.unionByName(
            state.join(F.broadcast(large), client_col, "left_semi").select(
                client_col,
                F.col("bucket").alias("_bucket"),
                F.lit(-1).cast("bigint").alias("_slot"),
                F.col("current").cast("int").alias("_n"),
                F.array(F.col("previous").cast("int")).alias("_ceilings"),
            )
        )
    walked = _whole_clients(slots, client_col).sortWithinPartitions(*keys)
    fields = [slim.schema[client_col]] + [
        T.StructField(name, T.LongType()) for name in ("_bucket", "_slot", "_previous", "_start")
    ]
    chain = walked.mapInPandas(_follow_slots(client_col), T.StructType(fields))

    ordered = Window.partitionBy(*keys).orderBy("_place")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    room = _allowance(F.col("_previous"), F.col("_elapsed"), limit) - F.col("_place")
    return (
        placed.join(chain, keys)
        .withColumn("_room", room)
        .withColumn("admitted", F.col("_room") >= F.least(F.col("_start"), F.min("_room").over(earlier)))
        .withColumn("_current", F.col("_place") + F.least(F.col("_start"), F.min("_room").over(ordered)))
        .select(client_col, id_col, "_at", "_previous", "_current", "_bucket", "admitted")
    )


def admission_replay(
    requests: DataFrame,
    limit: Limit = CHAT_LIMIT,
    client_col: str = "client",
    ts_col: str = "ts",
    id_col: str = "event_id",
    state: DataFrame | None = None,
    large_key_rows: int = LARGE_KEY_ROWS,
) -> DataFrame:
    """Decide every request: (client, id, decided_at, admitted, bucket,
    previous, current), the last three being the counts after the decision.

    Two-bucket rule, where only admitted requests count: reject when
    ``floor(share * previous) + current >= limit``.

    ``state(client, bucket, previous, current, last_at)`` continues an earlier
    batch, see ``state_after``. A request older than its client's last decision
    is decided on arrival, at the time of that decision. A request without a
    time stays undecided: everything but its client and id is null, and it counts for nobody.
    """
    kind = requests.schema[client_col].dataType

    def named(df: DataFrame) -> DataFrame:
        """Clients as texts that tell a missing one from all others."""
        return df.withColumn(client_col, F.coalesce(F.concat(F.lit("="), F.col(client_col).cast("string")), F.lit("")))

    timed = requests.filter(F.col(ts_col).isNotNull())
    undecided = requests.filter(F.col(ts_col).isNull())
    slim = named(timed.select(client_col, id_col, micros(F.col(ts_col)).alias("_at")))
    if state is not None:
        state = named(state)
        last = state.select(client_col, F.col("last_at").alias("_decided"))
        slim = slim.join(last, client_col, "left").withColumn("_at", F.greatest("_at", "_decided")).drop("_decided")
    large = large_keys(slim, [client_col], F.col("_at"), large_key_rows)
    if large is None:
        decided = _replay_in_order(slim, limit, client_col, id_col, state)
    else:
        ordinary = slim.join(F.broadcast(large), client_col, "left_anti")
        decided = _replay_in_order(ordinary, limit, client_col, id_col, state).unionByName(
            _replay_by_slots(slim, limit, client_col, id_col, state, large)
        )
    client = F.when(F.col(client_col) != "", F.substring(F.col(client_col), 2, 2_000_000_000)).cast(kind)
    decided = decided.select(
        client.alias(client_col), id_col, F.timestamp_micros("_at").alias("decided_at"), "admitted",
        F.col("_bucket").alias("bucket"), F.col("_previous").alias("previous"), F.col("_current").alias("current"),
    )
    return decided.unionByName(undecided.select(client_col, id_col), allowMissingColumns=True)


def state_after(
    decisions: DataFrame, state: DataFrame | None = None, client_col: str = "client", id_col: str = "event_id",
    seen_at: Column | None = None,
) -> DataFrame:
    """The state to go on from: each client's counts after its last decision.

    With ``seen_at`` the clients of ``decisions`` are marked with that time, and others keep theirs.
    """
    last_at = F.unix_micros("decided_at")
    last = F.max_by(F.struct("bucket", "previous", "current", last_at.alias("last_at")), F.struct(last_at, id_col))
    decisions = decisions.filter(F.col("decided_at").isNotNull())
    after = decisions.groupBy(client_col).agg(last.alias("_last")).select(client_col, "_last.*")
    if seen_at is not None:
        after = after.withColumn("seen_at", seen_at)
    if state is None:
        return after
    old, new = state.select(*after.columns).alias("old"), after.select(F.col(client_col).alias("_c"))
    return after.unionByName(old.join(new, F.col(client_col).eqNullSafe(F.col("_c")), "left_anti"))


def expire_state(state: DataFrame, newest_bucket: Column) -> DataFrame:
    """Drop clients whose last bucket is two or more behind: it no longer
    affects any decision at or after ``newest_bucket``."""
    return state.filter(F.col("bucket") >= newest_bucket - 1)


def drop_idle(state: DataFrame, idle_since: Column) -> DataFrame:
    """Drop clients not seen since ``idle_since``.

    That is a time of the log's reader, not of any client: a client idle for two
    windows comes back two windows later by its own clock too, wherever that stands, and
    its old counts no longer affect it. Clocks of different clients are never compared.
    """
    return state.filter(F.col("seen_at") >= idle_since)
