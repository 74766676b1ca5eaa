"""Each check with a passing and a failing input, contracts, roll-ups and freshness."""

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import values
from pyspark.sql import functions as F

from ledgerline.operators import quality as q
from ledgerline.plans import build, sales
from ledgerline.schemas import FCT_ORDERS, MART_DAILY_SALES
from ledgerline.sources import adapters

SMALL = "/root/testdata/sf0.001"


def test_row_checks(rows):
    frame = rows(
        [dict(n=1, k="a", due=True), dict(n=0, k="z"), dict(n=-1, due=True), dict(k="a")],
        "n int, k string, due boolean",
    )
    assert q.not_null(frame, "n").count() == 1
    assert values(q.accepted_values(frame, "k", ["a"]), "k") == [("z",)]
    assert q.accepted_values(frame, "k", ["a"], "n > 0").count() == 0
    assert values(q.conditional_not_null(frame, "k", "due"), "n") == [(-1,)]
    assert values(q.positive_when_present(frame, "n"), "n") == [(-1,), (0,)]
    assert values(q.non_negative(frame, "n"), "n") == [(-1,)]


def test_key_checks_and_null_rules(rows):
    frame = rows(
        [dict(a="x", b="1"), dict(a="x", b="1"), dict(a="x"), dict(a="y"), dict(a="y"), dict(b="2"), dict(b="3")],
        "a string, b string",
    )
    assert values(q.unique(frame, "a")) == [("x",), ("y",)]
    assert values(q.unique_combination(frame, ["a", "b"])) == [("x", "1"), ("y", None)]
    assert values(q.single_value_per_group(frame, "b", "a")) == [(None,)]
    assert q.single_value_per_group(frame.filter("a is not null"), "b", "a").count() == 0


def test_order_consistency(rows):
    frame = rows(
        [dict(order_id="1", user_id="u", currency="TWD", kafka_topic="t", kafka_partition=0, kafka_offset=1),
         dict(order_id="1", user_id="u", kafka_topic="t", kafka_partition=0, kafka_offset=2),
         dict(order_id="2", user_id="u", currency="TWD", kafka_topic="t", kafka_partition=0, kafka_offset=3),
         dict(order_id="2", user_id="v", currency="USD", kafka_topic="t", kafka_partition=1, kafka_offset=3),
         dict(order_id="3", user_id="v", kafka_topic="t", kafka_partition=1, kafka_offset=3)],
        "order_id string, user_id string, currency string, kafka_topic string, kafka_partition int, "
        "kafka_offset bigint",
    )
    for check in (q.single_partition_per_order, q.single_user_per_order, q.single_currency_per_order):
        assert values(check(frame)) == [("2",)]
    assert values(q.coordinate_unique(frame)) == [("t", 1, 3)]


def test_count_consistency(rows):
    names = "success_count bigint, client_error_count bigint, server_error_count bigint, request_count bigint"
    frame = rows([dict(success_count=1, client_error_count=1, server_error_count=1, request_count=3),
                  dict(success_count=1, client_error_count=1, server_error_count=1, request_count=4),
                  dict(success_count=1, request_count=9)], names)
    assert values(q.count_consistency(frame), "request_count") == [(4,)]


@pytest.mark.parametrize("clock, status", [
    (datetime(2026, 1, 1, 0, 30), "pass"), (datetime(2026, 1, 1, 0, 31), "warn"),
    (datetime(2026, 1, 1, 2, 0), "warn"), (datetime(2026, 1, 1, 2, 1), "error"),
])
def test_freshness(rows, clock, status):
    frame = rows([dict(t=datetime(2025, 1, 1)), dict(t=datetime(2026, 1, 1))], "t timestamp")
    assert q.freshness(frame, "t", clock).first().status == status


def test_freshness_of_an_empty_table_is_an_error(rows):
    assert q.freshness(rows([], "t timestamp"), "t", datetime(2026, 1, 1)).first().status == "error"


def test_contract_schema_is_enforced(spark):
    events = build.staging.order_events(adapters.valid_orders(spark, SMALL))
    daily = sales.daily_sales(events)
    assert q.schema_differences(daily, MART_DAILY_SALES) == []
    assert q.required_nulls(daily, MART_DAILY_SALES).count() == 0
    with pytest.raises(q.ContractError, match="channel: missing"):
        q.enforce_schema(daily.drop("channel"), MART_DAILY_SALES)
    with pytest.raises(q.ContractError, match="paid_order_count: is int"):
        q.enforce_schema(
            daily.withColumn("paid_order_count", F.col("paid_order_count").cast("int")), MART_DAILY_SALES
        )
    with pytest.raises(q.ContractError, match="out of order"):
        q.enforce_schema(daily.select(*reversed(daily.columns)), MART_DAILY_SALES)
    broken = build.orders.fct_orders(events).withColumn("user_id", F.lit(None).cast("string"))
    assert [r.column_name for r in q.required_nulls(broken, FCT_ORDERS).collect()] == ["user_id"]
    with pytest.raises(Exception, match="fct_orders.user_id must not be NULL"):
        q.enforce_contract(broken, FCT_ORDERS).write.format("noop").mode("overwrite").save()
    sound = q.enforce_contract(daily, MART_DAILY_SALES)
    assert values(sound) == values(daily)


def test_suites_pass_on_generated_tables_and_count_in_one_scan(spark):
    orders_table = adapters.valid_orders(spark, SMALL)
    suite = build.source_suites(orders_table, adapters.processed_events(spark, SMALL),
                                spark.createDataFrame([], build.CONTRACTS["mart_service_health"].schema)
                                .withColumns({"endpoint": F.lit("/"), "response_time_sum_ms": F.lit(0),
                                              "updated_at": F.current_timestamp()}))
    summary = q.summarise(suite)
    assert summary.filter("status <> 'pass'").count() == 0
    row_checks = q.Suite("t", orders_table, suite[0].row_checks).violation_counts()
    plan = row_checks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_failing_suite_is_reported(rows):
    frame = rows([dict(n=-1), dict(n=-2), dict(n=3)], "n int")
    suite = q.Suite("t", frame, {"n non-negative": q.is_negative("n")},
                    {"n unique": q.unique(frame, "n")})
    assert values(q.summarise([suite])) == [
        ("t", "n non-negative", 2, "fail"), ("t", "n unique", 0, "pass")
    ]


def test_rollup_and_gate(rows):
    results = rows([dict(unique_id="1", status="pass"), dict(unique_id="2", status="error"),
                    dict(unique_id="3", status="warn"), dict(unique_id="4", status="success"),
                    dict(unique_id="5", status="skipped")], "unique_id string, status string")
    parents = rows([dict(unique_id=t, asset_id=a) for t, a in
                    (("1", "a"), ("2", "a"), ("3", "b"), ("4", "b"), ("4", "c"), ("5", "d"))],
                   "unique_id string, asset_id string")
    assets = rows([dict(asset_id=a) for a in "abcde"], "asset_id string")
    assert values(q.result_rollup(results, parents, assets), "asset_id", "quality_status") == [
        ("a", "fail"), ("b", "warn"), ("c", "pass"), ("d", "unknown"), ("e", "unknown")
    ]
    assert q.gate(results).first().passed is False
    assert q.gate(results.filter("status in ('pass', 'warn')")).first().passed is True
    assert q.gate(results.limit(0)).first().passed is True


def test_changed_keys_counts_copies(rows):
    before = rows([dict(k="a"), dict(k="a"), dict(k="b")], "k string")
    after = rows([dict(k="a"), dict(k="b"), dict(k="c")], "k string")
    assert values(q.changed_keys(before, after, ["k"])) == [("a", 1), ("c", -1)]
    assert q.changed_keys(before, before, ["k"]).count() == 0


def test_money_is_decimal(spark):
    daily = sales.daily_sales(build.staging.order_events(adapters.valid_orders(spark, SMALL)))
    assert isinstance(daily.first().created_order_amount, Decimal)


def test_checks_of_one_key_share_a_scan_and_a_shuffle(spark):
    rows = spark.createDataFrame(
        [("a", "u", "TWD", "t", 0), ("a", "v", None, "t", 0), ("b", "u", "TWD", "t", 0), ("b", "u", "USD", "t", 1),
         (None, "x", None, "t", 1), (None, "y", "TWD", "s", 1)],
        "order_id string, user_id string, currency string, kafka_topic string, kafka_partition int",
    )
    suite = q.Suite("rows", rows, key_checks={
        "place": q.one_value(("kafka_topic", "kafka_partition"), "order_id"),
        "user": q.one_value(("user_id",), "order_id"),
        "currency": q.one_value(("currency",), "order_id"),
        "order unique": q.unique_key("order_id"),
        "pair unique": q.unique_keys(("order_id", "user_id")),
    })
    counts = suite.violation_counts()
    assert dict(values(counts)) == {"place": 2, "user": 2, "currency": 1, "order unique": 2, "pair unique": 1}
    for check, violations in (("place", q.single_partition_per_order(rows)),
                              ("user", q.single_user_per_order(rows)),
                              ("currency", q.single_currency_per_order(rows))):
        assert dict(values(counts))[check] == violations.count()
    # a plan that has not run yet is printed once
    plan = suite.violation_counts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2
