import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import throttle
from docquarry.operators.throttle import Limit
from docquarry.plans import catalog
from docquarry.sources.corpus import read_table

REQUESTS = "event_id long, client string, ts timestamp"
BASE = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    return spark.createDataFrame([(i, c, BASE + dt.timedelta(microseconds=m)) for i, c, m in rows], REQUESTS)


def crowd(seed, n=600, span=40_000_000):
    """One client makes most requests, some at the same moment."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = "hot" if rng.random() < 0.7 else f"c{rng.randrange(5)}"
        rows.append((i, client, rng.randrange(span) // 50_000 * 50_000))
    return rows


def counted(rows, window):
    return {i: sum(1 for _, d, u in rows if d == c and m - window <= u <= m) for i, c, m in rows}


def replayed(rows, limit, state=None):
    """The rule one request at a time."""
    base = int((BASE - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    window = limit.window_micros
    state = {} if state is None else state
    out = {}
    for i, client, m in sorted(rows, key=lambda r: (r[2], r[0])):
        at = base + m
        bucket, elapsed = at // window, at % window
        last, previous, current = state.get(client, (None, 0, 0))
        if last != bucket:
            previous, current = (current if last == bucket - 1 else 0), 0
        ok = math.floor((1 - elapsed / window) * previous) + current < limit.requests
        current += ok
        state[client] = (bucket, previous, current)
        out[i] = ok
    return out


@pytest.mark.parametrize("large", [10, 50, 1_000_000])
def test_flags_against_counting(spark, large):
    rows = crowd(1)
    limit = Limit(5, 3)
    got = throttle.throttle_flags(requests(spark, rows), limit, large_key_rows=large).collect()
    want = counted(rows, limit.window_micros)
    assert {r.event_id: r.attempts for r in got} == want
    assert {r.event_id: r.throttled for r in got} == {i: n > 5 for i, n in want.items()}


def test_window_is_closed_at_both_ends(spark):
    rows = [(0, "a", 0), (1, "a", 3_000_000), (2, "a", 6_000_001)]
    got = throttle.throttle_flags(requests(spark, rows), Limit(1, 3)).orderBy("event_id").collect()
    assert [r.attempts for r in got] == [1, 2, 1]


def timed_requests(spark, sf):
    """All events with their times; the registered queries take some of those away."""
    return read_table(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), "ts")


def test_flags_golden(spark, medium):
    flagged = throttle.throttle_flags(timed_requests(spark, medium), Limit(3, 86_400))
    assert flagged.filter("throttled").count() == 3_815 and flagged.count() == 10_000
    partly = catalog.throttle_flags(spark, medium)
    assert partly.count() == 10_000 and partly.filter("throttled IS NULL").count() == partly.filter("ts IS NULL").count() == 104


@pytest.mark.parametrize("large", [1, 50, 1_000_000])
@pytest.mark.parametrize("seed,limit", [(3, Limit(5, 3)), (4, Limit(20, 10)), (5, Limit(1, 1))])
def test_replay_against_the_rule(spark, seed, limit, large):
    rows = crowd(seed)
    got = throttle.admission_replay(requests(spark, rows), limit, large_key_rows=large).collect()
    assert {r.event_id: r.admitted for r in got} == replayed(rows, limit)


def test_replay_golden(spark, medium):
    asked = timed_requests(spark, medium)
    daily = throttle.admission_replay(asked, Limit(3, 86_400))
    assert daily.filter("admitted").count() == 8_354 and daily.count() == 10_000
    six_hours = throttle.admission_replay(asked, Limit(3, 21_600))
    assert six_hours.filter("NOT admitted").count() == 57


def test_a_rejection_needs_a_full_window(spark):
    rows = crowd(6)
    limit = Limit(5, 3)
    got = throttle.admission_replay(requests(spark, rows), limit).collect()
    admitted = [(r.client, r.decided_at.timestamp()) for r in got if r.admitted]
    for r in got:
        if not r.admitted:
            near = sum(1 for c, t in admitted if c == r.client and r.decided_at.timestamp() - 6 <= t <= r.decided_at.timestamp())
            assert near >= limit.requests


@pytest.mark.parametrize("large", [10, 1_000_000])
def test_batches_with_state_equal_one_batch(spark, large):
    rows = sorted(crowd(7), key=lambda r: (r[2], r[0]))
    limit = Limit(4, 3)
    state, got = None, {}
    for part in (rows[:200], rows[200:230], rows[230:]):
        decisions = throttle.admission_replay(requests(spark, part), limit, state=state, large_key_rows=large)
        decided = decisions.collect()
        got.update({r.event_id: r.admitted for r in decided})
        after = throttle.state_after(spark.createDataFrame(decided, decisions.schema), state)
        state = spark.createDataFrame(after.collect(), after.schema)
    assert got == replayed(rows, limit)


def test_both_routes_leave_the_same_counts(spark):
    rows = crowd(8)
    by_slots = throttle.admission_replay(requests(spark, rows), Limit(4, 3), large_key_rows=5)
    in_order = throttle.admission_replay(requests(spark, rows), Limit(4, 3))
    assert by_slots.exceptAll(in_order).count() == 0 and in_order.exceptAll(by_slots).count() == 0


def test_late_requests_are_decided_on_arrival(spark):
    limit = Limit(1, 10)
    after = throttle.state_after(throttle.admission_replay(requests(spark, [(0, "a", 5_000_000)]), limit))
    late = throttle.admission_replay(requests(spark, [(1, "a", 1_000_000), (2, "b", 1_000_000)]), limit, state=after)
    got = {r.event_id: (r.admitted, r.decided_at - BASE) for r in late.collect()}
    assert got == {1: (False, dt.timedelta(seconds=5)), 2: (True, dt.timedelta(seconds=1))}
    quiet = throttle.admission_replay(requests(spark, [(3, "b", 9_000_000)]), limit, state=after)
    assert {r.client for r in throttle.state_after(quiet, after).collect()} == {"a", "b"}


def test_state_expires_after_two_windows(spark):
    state = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "client string, bucket long")
    kept = throttle.expire_state(state, F.lit(7))
    assert sorted(r.client for r in kept.collect()) == ["b", "c"]


def test_burst_of_a_large_key_is_split_by_count(spark):
    from pyspark.sql import functions as F

    from docquarry.operators import scans

    rows = spark.range(20_000).select(F.lit(None).cast("string").alias("k"), F.when(F.col("id") == 0, 0).otherwise(10**12 + F.col("id")).alias("at"))
    large = scans.large_keys(rows, ["k"], F.col("at"), large_key_rows=1000)
    sizes = [r["count"] for r in scans.split_large_keys(rows, ["k"], F.col("at"), large).groupBy("_block").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 125 and min(sizes) > 0


@pytest.mark.parametrize("size", [3, 10_000])
def test_requests_without_a_client_are_decided(spark, size):
    import datetime as dt

    rows = [(i, None if i % 2 else "c", dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(12)]
    asked = spark.createDataFrame(rows, "event_id long, client string, ts timestamp")
    decided = throttle.admission_replay(asked, throttle.Limit(2, 60), large_key_rows=size).collect()
    assert len(decided) == 12
    for client in (None, "c"):
        assert [r.admitted for r in sorted((d for d in decided if d.client == client), key=lambda d: d.event_id)] == [True] * 2 + [False] * 4
    flagged = throttle.throttle_flags(asked, throttle.Limit(2, 60), large_key_rows=size)
    assert flagged.count() == 12 and flagged.filter("throttled").count() == 8


def test_requests_without_a_time_stay_undecided(spark):
    rows = [(1, "a", dt.datetime(2024, 1, 1)), (2, "a", None), (3, None, None), (4, "a", dt.datetime(2024, 1, 1, 1))]
    asked = spark.createDataFrame(rows, "event_id long, client string, ts timestamp")
    for large in (1_000_000, 1):
        found = {r.event_id: (r.client, r.admitted, r.decided_at) for r in throttle.admission_replay(asked, Limit(1, 86_400), large_key_rows=large).collect()}
        assert found == {1: ("a", True, rows[0][2]), 2: ("a", None, None), 3: (None, None, None), 4: ("a", False, rows[3][2])}
        flags = {r.event_id: (r.attempts, r.throttled) for r in throttle.throttle_flags(asked, Limit(1, 86_400), large_key_rows=large).collect()}
        assert flags == {1: (1, False), 2: (None, None), 3: (None, None), 4: (2, True)}
    assert throttle.state_after(throttle.admission_replay(asked, Limit(1, 86_400))).count() == 1
