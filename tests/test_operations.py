"""Offset intervals, lag, percentiles and delivery counters."""

import math
import random
from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from ledgerline.functions.exprs import floored_rate, is_stale
from ledgerline.operators import delivery, intervals, lag, percentiles

OFFSETS = "topic string, partition int, offset bigint"
INTERVALS = "topic string, partition int, start_offset bigint, end_offset_exclusive bigint"


def merged(offsets):
    result = []
    for offset in sorted(set(offsets)):
        if result and result[-1][1] == offset:
            result[-1][1] = offset + 1
        else:
            result.append([offset, offset + 1])
    return [tuple(pair) for pair in result]


@pytest.mark.parametrize("segment", [1, 2, 5, 10, 1_000_000])
def test_coalesced_offsets_match_brute_force(rows, segment):
    rng = random.Random(7)
    offsets = {("a", p): [rng.randrange(60) for _ in range(n)] for p, n in ((0, 90), (1, 25), (2, 1))}
    offsets[("b", 0)] = list(range(3, 41))
    frame = rows(
        [dict(topic=t, partition=p, offset=o) for (t, p), found in offsets.items() for o in found],
        OFFSETS,
    )
    expected = sorted(
        ((t, p, *pair) for (t, p), found in offsets.items() for pair in merged(found)), key=repr
    )
    assert values(intervals.coalesce_offsets(frame, segment)) == expected


@pytest.mark.parametrize("segment", [1, 4, 1_000_000])
def test_interval_membership_is_exact(rows, segment):
    frame = rows(
        [dict(topic=t, partition=p, offset=o) for t in "ab" for p in (0, 1) for o in range(30)],
        OFFSETS,
    )
    wanted = rows(
        [dict(topic="a", partition=0, start_offset=3, end_offset_exclusive=9),
         dict(topic="a", partition=0, start_offset=5, end_offset_exclusive=12),
         dict(topic="b", partition=1, start_offset=29, end_offset_exclusive=99),
         dict(topic="b", partition=0, start_offset=4, end_offset_exclusive=4)],
        INTERVALS,
    )
    found = intervals.within_intervals(frame, wanted, topic="topic", partition="partition",
                                       offset="offset", segment_offsets=segment)
    expected = [("a", 0, o) for o in range(3, 12)] + [("b", 1, 29)]
    assert values(found) == sorted(expected, key=repr)


@pytest.mark.parametrize("committed, expected", [(12, 2), (20, 5), (9, 0), (None, 0)])
def test_consumed_count(rows, committed, expected):
    run = rows([dict(topic="t", partition=0, start_offset=10, end_offset_exclusive=15)], INTERVALS)
    commits = rows([dict(topic="t", partition=0, current_offset=committed)] if committed else [],
                   "topic string, partition int, current_offset bigint")
    assert intervals.consumed_count(run, commits).first()[0] == expected


def test_lag_states_and_totals(rows):
    ends = rows([dict(topic="t", partition=p, log_end_offset=10) for p in range(4)],
                "topic string, partition int, log_end_offset bigint")
    commits = rows(
        [dict(consumer_group="g", topic="t", partition=0, committed_offset=4),
         dict(consumer_group="g", topic="t", partition=1, committed_offset=-1001),
         dict(consumer_group="g", topic="t", partition=2, committed_offset=11),
         *[dict(consumer_group="full", topic="t", partition=p, committed_offset=p) for p in range(4)]],
        "consumer_group string, topic string, partition int, committed_offset bigint",
    )
    groups = rows(
        [dict(consumer_group="g", topic="t", is_established=True),
         dict(consumer_group="full", topic="t", is_established=True),
         dict(consumer_group="never", topic="t", is_established=False)],
        "consumer_group string, topic string, is_established boolean",
    )
    found = lag.partition_lag(ends, commits, groups)
    assert values(found.filter("consumer_group = 'g'"), "partition", "lag", "status") == [
        (0, 6, "measured"), (1, None, "offset_not_available"), (2, None, "invalid_negative_lag"),
        (3, None, "offset_not_available"),
    ]
    totals = lag.group_lag(found)
    assert values(totals, "consumer_group", "total_lag", "status") == [
        ("full", 34, "measured"), ("g", None, "partial"), ("never", None, "group_not_established")
    ]
    assert lag.combined_lag(totals).first()[0] is None
    assert lag.combined_lag(totals.filter("consumer_group = 'full'")).first()[0] == 34


def test_benchmark_and_observed_lag(rows):
    samples = rows(
        [dict(observed_at=datetime(2026, 1, d), lag=lag_value, log_end_offset=end)
         for d, lag_value, end in ((1, 5, 9), (1, None, 0), (2, 90, 99), (2, 1, 4), (3, None, 7), (3, 2, 3))],
        "observed_at timestamp, lag bigint, log_end_offset bigint",
    )
    per_snapshot = lag.benchmark_lag(samples, ["observed_at"])
    assert [v for _, v in values(per_snapshot)] == [5, 91, None]
    assert tuple(lag.observed_lag(per_snapshot).first()) == (91, None)


def nearest_rank(sample, p):
    return sorted(sample)[math.ceil(p * len(sample)) - 1]


@pytest.mark.parametrize("sample", [
    [40.0, 10.0, 30.0, 20.0], [1.0, 2.0], [5.0], [3.0] * 50 + [1.0], [-4.5, -4.5, 0.0, 1e-9, 1e12, 2.5],
])
def test_percentiles_match_nearest_rank(rows, sample):
    frame = rows([dict(v=v) for v in [*sample, None]], "v double")
    points = [0.01, 0.5, 0.95, 1.0]
    found = dict(values(percentiles.nearest_rank_percentiles(frame, "v", points)))
    assert found == {p: nearest_rank(sample, p) for p in points}


def test_percentiles_per_group_with_random_samples(rows):
    rng = random.Random(3)
    groups = {g: [rng.lognormvariate(2, 3) * rng.choice((-1, 1)) for _ in range(n)]
              for g, n in (("a", 700), ("b", 41), ("c", 1))}
    frame = rows([dict(g=g, v=v) for g, vs in groups.items() for v in vs], "g string, v double")
    points = [0.05, 0.37, 0.5, 0.99]
    found = {(g, p): v for g, p, v in values(
        percentiles.nearest_rank_percentiles(frame, "v", points, ["g"]))}
    assert found == {(g, p): nearest_rank(vs, p) for g, vs in groups.items() for p in points}


def test_membership_with_every_second_offset_is_linear(spark):
    delivered = spark.range(0, 60_000, 2).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"))
    ranges = intervals.coalesce_offsets(delivered)
    rows = spark.range(60_000).select(F.lit("t").alias("kafka_topic"), F.lit(0).alias("kafka_partition"),
                                      F.col("id").alias("kafka_offset"))
    found = intervals.within_intervals(rows, ranges)
    assert found.columns == rows.columns
    assert found.agg(F.count("*"), F.max(F.col("kafka_offset") % 2)).first()[:] == (30_000, 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_percentiles_of_a_null_group_and_of_nan(rows):
    frame = rows([dict(g=None, v=1.0), dict(g=None, v=2.0), dict(g="a", v=float("nan")),
                  dict(g="a", v=2.0), dict(g="a", v=3.0)], "g string, v double")
    found = {r.g: r for r in percentiles.sample_summary(frame, "v", [0.5, 1.0], ["g"]).collect()}
    assert (found[None].sample_count, found[None].p50, found[None].p100) == (2, 1.0, 2.0)
    assert found["a"].p50 == 3.0 and found["a"].p100 != found["a"].p100


def test_percentiles_of_nothing(rows):
    empty = rows([], "v double")
    assert percentiles.nearest_rank_percentiles(empty, "v", [0.5]).count() == 0
    assert tuple(percentiles.sample_summary(empty, "v", [0.5]).first()) == (0, None, None)
    for p in (0, 1.5):
        with pytest.raises(ValueError):
            percentiles.nearest_rank_percentiles(empty, "v", [p])


def test_delivery_counters(rows):
    names = ("family", "injection_kind", "invalid_kind", "outcome")
    attempts = rows(
        [dict(zip(names, r, strict=True)) for r in [
            ("order", "normal", None, "delivered"), ("order", "duplicate", None, "delivered"),
            ("log", "duplicate", None, "failed"), ("log", "invalid", "bad_type", None),
            ("log", "stale", None, "delivered")]],
        "family string, injection_kind string, invalid_kind string, outcome string",
    )
    counted = delivery.delivery_counters(attempts).first().asDict()
    assert counted == dict(
        attempted=5, delivered=3, failed=1, pending=1, order_events_attempted=2,
        log_events_attempted=3, invalid_events_injected=1, stale_events_injected=1,
        duplicate_events_injected=2, duplicate_events_delivered=1)
    assert values(delivery.invalid_by_type(attempts)) == [("bad_type", 1)]


def test_rate_and_staleness(rows):
    frame = rows([dict(n=10, s=0.0)], "n bigint, s double")
    assert frame.select(floored_rate("n", "s")).first()[0] == pytest.approx(1e10)
    times = rows([dict(t=datetime(2026, 1, 1)), dict(t=datetime(2026, 1, 1, 0, 1)), dict()], "t timestamp")
    clock = F.lit("2026-01-02 00:00:30").cast("timestamp")
    assert [r[0] for r in times.select(is_stale("t", clock)).collect()] == [True, False, None]
