"""Golden lifecycle and service-health cases, invariance under input order, skewed orders."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import values
from pyspark.sql import functions as F

from ledgerline.functions.exprs import safe_divide
from ledgerline.operators.sequencing import order_event_sequence
from ledgerline.plans import health, orders, sales

EVENT = (
    "event_id string, order_id string, event_type string, user_id string, product_id string, "
    "quantity int, amount double, currency string, channel string, event_time timestamp, "
    "event_date date, kafka_topic string, kafka_partition int, kafka_offset bigint, "
    "event_sequence_number bigint"
)
BY_SEQUENCE = ("event_sequence_number", "event_id")


def at(minute, hour=0):
    return datetime(2026, 8, 6, hour, minute)


def lifecycle(rows, *steps, order_id="ORD-1"):
    events = [
        dict(
            event_id=f"{order_id}-{n}",
            order_id=order_id,
            user_id="USR-1",
            event_sequence_number=n,
            event_time=at(n),
            **(step if isinstance(step, dict) else {"event_type": step}),
        )
        for n, step in enumerate(steps, 1)
    ]
    return rows(events, EVENT)


@pytest.mark.parametrize(
    "steps, state, attempts, failures, paid, cancelled",
    [
        (["order_created", "order_paid"], "paid", 1, 0, True, False),
        (["order_created", "payment_failed", "order_paid"], "paid", 2, 1, True, False),
        (["order_created", "order_cancelled"], "cancelled", 0, 0, False, True),
        (["order_created", "order_paid", "order_cancelled"], "cancelled", 1, 0, True, True),
        (["order_paid", "something_else"], None, 1, 0, True, False),
    ],
)
def test_latest_state(rows, steps, state, attempts, failures, paid, cancelled):
    result = orders.latest_order_state(lifecycle(rows, *steps), BY_SEQUENCE).first()
    assert result.latest_order_state == state
    assert (result.payment_attempt_count, result.payment_failure_count) == (attempts, failures)
    assert (result.is_paid, result.is_cancelled) == (paid, cancelled)
    assert result.order_event_count == len(steps)


def test_currency_change_stays_visible(rows):
    events = lifecycle(
        rows,
        dict(event_type="order_created", currency="TWD", amount=100.0),
        dict(event_type="order_paid", currency="USD", amount=10.0),
    )
    result = orders.latest_order_state(events, BY_SEQUENCE).first()
    assert (result.currency, result.latest_paid_currency) == ("TWD", "USD")


def test_latest_follows_stream_order_not_event_time(rows):
    events = rows(
        [
            dict(event_id="a", order_id="O", event_type="order_created", user_id="U",
                 event_time=at(0, 2), event_sequence_number=1),
            dict(event_id="b", order_id="O", event_type="payment_failed", user_id="U",
                 event_time=at(0, 1), event_sequence_number=2),
        ],
        EVENT,
    )
    result = orders.latest_order_state(events, BY_SEQUENCE).first()
    assert result.latest_event_type == result.latest_order_state == "payment_failed"
    assert result.latest_event_at == at(0, 1)


def test_first_pick_keeps_a_null(rows):
    events = lifecycle(
        rows,
        dict(event_type="order_created"),
        dict(event_type="order_created", product_id="P2"),
    )
    assert orders.latest_order_state(events, BY_SEQUENCE).first().product_id is None


def test_event_id_breaks_coordinate_ties(rows):
    events = rows(
        [
            dict(event_id="62", order_id="O", event_type="order_paid", event_time=at(1),
                 kafka_topic="t", kafka_partition=0, kafka_offset=10),
            dict(event_id="61", order_id="O", event_type="order_created", event_time=at(0),
                 kafka_topic="t", kafka_partition=0, kafka_offset=10),
        ],
        EVENT,
    ).drop("event_sequence_number")
    found = values(
        order_event_sequence(events),
        "event_id",
        "event_sequence_number",
        "previous_event_type",
        "next_event_type",
        "seconds_since_previous_event",
    )
    assert found == [
        ("61", 1, None, "order_paid", None),
        ("62", 2, "order_created", None, Decimal("60.000000")),
    ]


@pytest.mark.parametrize("segment", [1, 7, 1000, 1_000_000])
def test_sequence_of_a_hot_order_does_not_depend_on_segments(spark, segment):
    """One order holds a third of all rows; a plain window is the expected result."""
    kinds = F.array(*[F.lit(k) for k in ("order_created", "order_paid", "payment_failed")])
    events = spark.range(600).select(
        F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT"))
        .otherwise(F.concat(F.lit("o"), (F.col("id") % 50).cast("string")))
        .alias("order_id"),
        F.element_at(kinds, (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10**6))).alias("event_time"),
        F.lit("t").alias("kafka_topic"),
        (F.col("id") % 2).cast("int").alias("kafka_partition"),
        (F.col("id") * 5).alias("kafka_offset"),
    )
    events.createOrReplaceTempView("hot_events")
    expected = spark.sql(
        """
        SELECT event_id, row_number() OVER w AS event_sequence_number,
               lag(event_type) OVER w AS previous_event_type,
               lead(event_type) OVER w AS next_event_type,
               lag(event_time) OVER w AS previous_event_time,
               first(event_time) OVER whole
                   AS first_event_time,
               last(event_time) OVER whole
                   AS latest_event_time
        FROM hot_events
        WINDOW w AS (PARTITION BY order_id
                     ORDER BY kafka_topic, kafka_partition, kafka_offset, event_id),
               whole AS (PARTITION BY order_id
                         ORDER BY kafka_topic, kafka_partition, kafka_offset, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        """
    )
    found = order_event_sequence(events, segment)
    assert values(found, *expected.columns) == values(expected)


def test_sequence_plan_never_partitions_rows_by_order_alone(spark):
    events = spark.createDataFrame(
        [], EVENT.replace(", event_sequence_number bigint", "")
    )
    plan = order_event_sequence(events)._jdf.queryExecution().executedPlan().toString()
    windows_over_rows = [
        line for line in plan.splitlines() if "Window" in line and "row_number" in line
    ]
    assert windows_over_rows
    assert all("_segment" in line for line in windows_over_rows)


SALES_EVENT = "order_id string, event_type string, event_date date, amount decimal(18,2), currency string"
DAY = date(2026, 8, 6)


def sale(order, kind, amount, currency):
    return dict(order_id=order, event_type=kind, event_date=DAY,
                amount=amount and Decimal(amount), currency=currency)


def test_daily_sales_keeps_currencies_separate(rows):
    events = rows(
        [
            sale("T", "order_created", "100.00", "TWD"),
            sale("T", "order_paid", "100.00", "TWD"),
            sale("U", "order_created", "20.00", "USD"),
            sale("U", "order_paid", "20.00", "USD"),
        ],
        SALES_EVENT,
    )
    creation = rows(
        [dict(order_id="T", currency="TWD", channel="web"),
         dict(order_id="U", currency="USD", channel="ios")],
        "order_id string, currency string, channel string",
    )
    found = values(
        sales.daily_sales(events, creation),
        "currency", "channel", "created_order_count", "created_order_amount",
        "paid_order_count", "payment_success_rate",
    )
    assert found == [
        ("TWD", "web", 1, Decimal("100.00"), 1, Decimal("1.000000000000000000")),
        ("USD", "ios", 1, Decimal("20.00"), 1, Decimal("1.000000000000000000")),
    ]


def test_daily_sales_cancellation_takes_order_currency_and_counts_orders_once(rows):
    events = rows(
        [
            sale("A", "order_created", "5.00", "TWD"),
            sale("A", "order_cancelled", None, None),
            sale("A", "order_cancelled", None, "USD"),
            sale("B", "payment_failed", "7.00", "USD"),
            sale("B", "payment_failed", "7.00", "USD"),
        ],
        SALES_EVENT,
    )
    creation = rows(
        [dict(order_id="A", currency="TWD", channel="web")],
        "order_id string, currency string, channel string",
    )
    found = values(
        sales.daily_sales(events, creation),
        "currency", "channel", "cancelled_order_count", "payment_failed_order_count",
        "payment_failed_amount", "payment_attempt_count", "payment_success_rate",
    )
    assert found == [
        ("TWD", "web", 1, 0, Decimal("0.00"), 0, None),
        ("USD", None, 0, 1, Decimal("14.00"), 2, Decimal("0E-18")),
    ]


MINUTE = (
    "metric_minute timestamp, metric_date date, service string, endpoint string, "
    "request_count bigint, success_count bigint, client_error_count bigint, "
    "server_error_count bigint, response_time_sum_ms bigint, max_response_time_ms int"
)


def minute(service, endpoint, *counts):
    names = ("request_count", "success_count", "client_error_count", "server_error_count",
             "response_time_sum_ms", "max_response_time_ms")
    return dict(metric_minute=at(0), metric_date=DAY, service=service, endpoint=endpoint,
                **dict(zip(names, counts, strict=True)))


def test_service_health_weights_latency(rows):
    minutes = rows(
        [minute("api", "/fast", 9, 9, 0, 0, 90, 10), minute("api", "/slow", 1, 0, 0, 1, 100, 100)],
        MINUTE,
    )
    result = health.service_health(minutes).first()
    assert result.weighted_average_response_time_ms == Decimal(19)
    assert (result.request_count, result.max_response_time_ms, result.endpoint_count) == (10, 100, 2)


def test_zero_requests_give_null_rates(rows):
    result = health.service_health(rows([minute("idle", "/h", 0, 0, 0, 0, 0, 0)], MINUTE)).first()
    assert result.success_rate is None and result.error_rate is None
    assert result.weighted_average_response_time_ms is None


@pytest.mark.parametrize(
    "status, expected",
    [(100, (1, 0, 0)), (399, (1, 0, 0)), (400, (0, 1, 0)), (499, (0, 1, 0)), (500, (0, 0, 1)),
     (599, (0, 0, 1))],
)
def test_status_bounds(rows, status, expected):
    events = rows(
        [dict(event_time=at(3), service="s", endpoint="/e", status_code=status, response_time_ms=4)],
        "event_time timestamp, service string, endpoint string, status_code int, response_time_ms int",
    ).withColumn("updated_at", F.col("event_time"))
    result = health.minute_metrics_from_access_events(events).first()
    assert (result.success_count, result.client_error_count, result.server_error_count) == expected
    assert result.metric_minute == at(3)


def test_safe_divide(rows):
    frame = rows([dict(a=1, b=3), dict(a=1, b=0), dict(a=1)], "a bigint, b bigint")
    found = [row[0] for row in frame.select(safe_divide("a", "b")).collect()]
    assert found == [Decimal("0.333333333333333333"), None, None]
