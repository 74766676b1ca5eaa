"""Acceptance and rejection of raw records, and the dead letters made from them."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.validation import (
    ACCESS_LOGS,
    ALL_EVENTS,
    ORDERS,
    dead_letters,
    decode,
)
from ledgerline.schemas import RAW_RECORD
from ledgerline.sources.tables import dead_letter_messages

ID = "00000000-0000-0000-0000-00000000000a"
CREATED = dict(order_id=" O1\t", user_id="U1", product_id="P1", quantity=2, amount="1800.00",
               currency="TWD", channel="web")
PAID = dict(order_id="O1", user_id="U1", payment_id="Y1", amount=12.5, currency="USD",
            payment_method="card")
CANCELLED = dict(order_id="O1", user_id="U1", cancellation_reason="no")
FAILED = dict(order_id="O1", user_id="U1", payment_id="Y1", amount="1", currency="USD",
              failure_code="c", failure_reason="r")
ACCESS = dict(request_id="R", service="api", endpoint="/a", http_method="GET", status_code=200,
              response_time_ms=0, client_ip="10.0.0.1")
ERROR_LOG = dict(request_id="R", service="api", error_type="E", error_message="m")


def event(kind, payload, **changes):
    body = dict(event_id=ID, event_type=kind, event_time="2026-08-06T08:00:00+08:00",
                source="test", payload=payload)
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v != "absent"}).encode()


def verdicts(spark, bodies, family):
    records = [(b"k", body, "t", 0, n, None) for n, body in enumerate(bodies)]
    frame = spark.createDataFrame(records, RAW_RECORD)
    return sorted(decode(frame, family).collect(), key=lambda row: row.offset)


def without(payload, name):
    return {key: value for key, value in payload.items() if key != name}


def test_valid_orders_are_typed(spark):
    bodies = [
        event("order_created", CREATED),
        event("order_paid", PAID, event_version=1),
        event("order_cancelled", CANCELLED, event_id=ID.replace("-", "").upper()),
        event("payment_failed", FAILED, event_time="2026-08-06T00:00:00.123456Z"),
        event("order_created", {**CREATED, "quantity": "2.0", "amount": "0.001"}),
        event("order_created", {**CREATED, "amount": "2.345"}, event_id="{" + ID + "}"),
        event("order_created", CREATED, event_time="1999-01-01T00:00:00Z"),
    ]
    rows = verdicts(spark, bodies, ORDERS)
    assert [row.error_type for row in rows] == [None] * len(bodies)
    assert {row.event_id for row in rows} == {ID}
    first = rows[0]
    assert (first.order_id, first.quantity, str(first.amount)) == ("O1", 2, "1800.00")
    assert first.event_time.isoformat() == "2026-08-06T00:00:00"
    assert str(rows[1].amount) == "12.50"
    assert (rows[4].quantity, str(rows[4].amount)) == (2, "0.00")
    assert str(rows[5].amount) == "2.35"


ORDER_REJECTIONS = {
    "missing field": (event("order_created", without(CREATED, "order_id")), "payload.order_id"),
    "negative amount": (event("order_created", {**CREATED, "amount": "-1.00"}), "payload.amount"),
    "amount not a number": (event("order_created", {**CREATED, "amount": "NaN"}), "payload.amount"),
    "amount flag": (event("order_created", {**CREATED, "amount": True}), "payload.amount"),
    "currency": (event("order_created", {**CREATED, "currency": "EUR"}), "payload.currency"),
    "channel": (event("order_created", {**CREATED, "channel": "store"}), "payload.channel"),
    "quantity zero": (event("order_created", {**CREATED, "quantity": 0}), "payload.quantity"),
    "quantity fraction": (event("order_created", {**CREATED, "quantity": 1.5}), "payload.quantity"),
    "number for text": (event("order_created", {**CREATED, "user_id": 5}), "payload.user_id"),
    "null text": (event("order_created", {**CREATED, "user_id": None}), "payload.user_id"),
    "blank text": (event("order_cancelled", {**CANCELLED, "cancellation_reason": "  "}),
                   "payload.cancellation_reason"),
    "foreign field": (event("order_cancelled", {**CANCELLED, "amount": "1"}),
                      "payload.amount: unknown field"),
    "extra envelope field": (event("order_paid", PAID, debug=1), "debug: unknown field"),
    "list payload": (event("order_paid", [1]), "payload: must be an object"),
    "absent payload": (event("order_paid", "absent"), "payload: must be an object"),
    "unknown type": (event("order_shipped", PAID), "event_type"),
    "log type": (event("api_access_log", ACCESS), "event_type"),
    "absent type": (event("absent", PAID), "event_type"),
    "naive time": (event("order_paid", PAID, event_time="2026-08-06T00:00:00"), "event_time"),
    "epoch time": (event("order_paid", PAID, event_time=1786000000), "event_time"),
    "impossible time": (event("order_paid", PAID, event_time="2026-13-06T00:00:00Z"), "event_time"),
    "version two": (event("order_paid", PAID, event_version=2), "event_version"),
    "text version": (event("order_paid", PAID, event_version="1"), "event_version"),
    "null version": (event("order_paid", PAID, event_version=None), "event_version"),
    "bad id": (event("order_paid", PAID, event_id="abc"), "event_id"),
    "blank source": (event("order_paid", PAID, source="  "), "source"),
    "not an object": (b"[1]", "record"),
    "json null": (b"null", "record"),
}


def test_order_rejections_name_the_field_and_no_value(spark):
    rows = verdicts(spark, [body for body, _ in ORDER_REJECTIONS.values()], ORDERS)
    for (name, (_, location)), row in zip(ORDER_REJECTIONS.items(), rows, strict=True):
        assert row.error_type == "ValidationError", name
        assert row.error_message.startswith(location), (name, row.error_message)
    assert all("store" not in row.error_message for row in rows)


def test_undecodable_records(spark):
    bodies = [b"{", b"", None, b"\xff\xfe", b'{"a": 1} trailing', b'{"a":1}],[', b'1,"x":2',
              b'{"event_id": 1, "event_id": 2}']
    rows = verdicts(spark, bodies, ORDERS)
    assert {row.error_type for row in rows} == {"JSONDecodeError"}
    assert rows[3].error_message == "payload is not valid UTF-8"


def test_storage_limits_are_quarantined(spark):
    bodies = [
        event("order_created", {**CREATED, "order_id": "x" * 65}),
        event("order_created", {**CREATED, "amount": "12345678901234567"}),
        event("order_created", {**CREATED, "amount": 1e300}),
        event("order_created", {**CREATED, "quantity": 2**31}),
        event("order_created", {**CREATED, "order_id": " " + "x" * 64}),
    ]
    rows = verdicts(spark, bodies, ORDERS)
    assert [row.error_type for row in rows] == ["StorageConstraintError"] * 4 + [None]


def test_messages_are_whole_and_show_no_values(spark):
    row = verdicts(spark, [event("order_paid", {**PAID, **{f"k{n}" * 9: 1 for n in range(99)}})], ORDERS)[0]
    assert all(f"k{n}" * 9 in row.error_message for n in range(99))


def test_access_log_types(spark):
    bodies = [
        event("api_access_log", ACCESS),
        event("absent", ACCESS),
        event("order_created", CREATED),
        event("application_error_log", ERROR_LOG),
        event(None, ACCESS),
        event(7, ACCESS),
        event("api_access_log", {**ACCESS, "status_code": 700}),
        event("api_access_log", {**ACCESS, "http_method": "TRACE"}),
        event("api_access_log", {**ACCESS, "endpoint": "a"}),
        event("api_access_log", {**ACCESS, "response_time_ms": -1}),
        event("api_access_log", {**ACCESS, "status_code": "599"}),
    ]
    rows = verdicts(spark, bodies, ACCESS_LOGS)
    other, invalid = "UnsupportedEventType", "ValidationError"
    assert [row.error_type for row in rows] == [
        None, None, other, other, invalid, other, invalid, invalid, invalid, invalid, None
    ]
    assert rows[1].event_type == "api_access_log"


def test_all_six_types_can_be_read_together(spark):
    bodies = [
        event("order_created", CREATED),
        event("api_access_log", ACCESS),
        event("application_error_log", ERROR_LOG),
        event("application_error_log", {**ERROR_LOG, "endpoint": None, "stack_trace": "", "trace_id": "t"}),
        event("application_error_log", {**ERROR_LOG, "endpoint": "x"}),
        event("application_error_log", {**ERROR_LOG, "trace_id": " "}),
    ]
    rows = verdicts(spark, bodies, ALL_EVENTS)
    assert [row.error_type for row in rows] == [None] * 4 + ["ValidationError"] * 2


def test_dead_letters_keep_payload_key_and_coordinate(spark):
    broken = event("order_paid", {**PAID, "currency": "EUR"}, event_id=f"urn:uuid:{ID}")
    records = [
        (b"O1", broken, "orders", 2, 7, None),
        (b"\xff", b"\xff\xfe", "orders", 2, 8, None),
        (None, b"{", "orders", 2, 9, None),
        (b"O1", b"null", "orders", 2, 10, None),
        (b"O1", b'[{"event_id": 1}]', "orders", 2, 11, None),
    ]
    decoded = decode(spark.createDataFrame(records, RAW_RECORD), ORDERS)
    letters = dead_letters(decoded, "group", F.lit("2026-08-06").cast("timestamp"))
    rows = sorted(letters.collect(), key=lambda row: row.original_offset)
    assert [row.dlq_key for row in rows] == [ID, "orders:2:8", "orders:2:9", "orders:2:10", "orders:2:11"]
    assert [row.original_payload_encoding for row in rows] == ["json", "base64", "utf-8", "utf-8", "json"]
    assert json.loads(rows[0].original_payload) == json.loads(broken)
    assert base64.b64decode(rows[1].original_payload) == b"\xff\xfe"
    assert rows[1].original_key == base64.b64encode(b"\xff").decode()
    assert (rows[2].original_key, rows[2].original_payload) == ("", "{")
    messages = {row["key"]: json.loads(row["value"]) for row in dead_letter_messages(letters).collect()}
    assert messages[ID]["original_payload"] == json.loads(broken)
    assert messages["orders:2:9"]["original_payload"] == "{"
    assert messages[ID]["failed_at"] == "2026-08-06T00:00:00.000000Z"


@pytest.mark.parametrize("text, valid", [
    ("2026-08-06T00:00:00Z", True), ("2026-08-06 00:00:00+00:00", True),
    ("2026-08-06T00:00Z", True), ("2026-08-06T00:00:00-0530", True),
    ("2026-08-06", False), ("yesterday", False), ("2026-08-06T00:00:00 Z", False),
])
def test_timestamps(spark, text, valid):
    row = verdicts(spark, [event("order_paid", PAID, event_time=text)], ORDERS)[0]
    assert (row.error_type is None) == valid
