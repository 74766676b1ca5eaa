"""Incremental maintenance equals a full rebuild; reads are bounded and pruned."""

from datetime import date, datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from ledgerline.plans import build, health, incremental, marts, orders, sales, staging
from ledgerline.registry import queries
from ledgerline.registry.queries import log_metrics_minute
from ledgerline.schemas import CONTRACTS, MART_DAILY_SALES
from ledgerline.sources import adapters

SMALL = "/root/testdata/sf0.001"
CUTOFF = datetime(2024, 1, 25)


@pytest.fixture(scope="module")
def events(spark):
    return staging.order_events(adapters.valid_orders(spark, SMALL))


def published(spark, root, valid_orders):
    models = build.build(
        valid_orders, adapters.processed_events(spark, SMALL), log_metrics_minute(spark, SMALL)
    )
    build.publish(models, root)
    return root


@pytest.fixture
def full_marts(spark, tmp_path):
    return published(spark, f"{tmp_path}/marts", adapters.valid_orders(spark, SMALL))


def test_published_marts_equal_their_models(spark, full_marts, events):
    daily = build.read_mart_files(spark, full_marts, "mart_daily_sales")
    assert values(daily) == values(sales.daily_sales(events))
    facts = build.read_mart_files(spark, full_marts, "fct_order_events")
    assert values(facts) == values(orders.fct_order_events(events))


def scans_of(frame, column):
    """Partition filters of the scans in the plan that read a column."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and f"{column}#" in line]
    return [scan[scan.index("PartitionFilters") : scan.index("PushedFilters")] for scan in scans]


def test_refresh_from_arrived_events_equals_a_rebuild(spark, tmp_path, events):
    early = adapters.valid_orders(spark, SMALL).filter(F.col("created_at") < F.lit(CUTOFF))
    root = published(spark, f"{tmp_path}/marts", early)
    arrived = events.filter(F.col("persisted_at") >= F.lit(CUTOFF))
    read = lambda name: build.read_mart_files(spark, root, name)
    for _ in range(2):
        incremental.refresh_sales(spark, events, arrived, root)
        assert values(read("mart_daily_sales")) == values(sales.daily_sales(events))
        assert values(read("fct_orders")) == values(orders.fct_orders(events))
        assert values(read("fct_order_events")) == values(orders.fct_order_events(events))
    assert incremental.refresh_sales(spark, events, arrived.limit(0), root) == []


def test_a_late_creation_changes_all_days_of_its_order_and_no_other(spark, tmp_path, events, monkeypatch):
    """Only the order's days are scanned in the event fact, also those far before any lookback."""
    whole = adapters.valid_orders(spark, SMALL)
    created = F.col("event_type") == "order_created"
    several = events.groupBy("order_id").agg(
        F.count_distinct("event_date").alias("days"), F.count_if(created).alias("creations"),
        F.min("event_date").alias("first"),
    )
    order = several.filter("days > 1 and creations > 0").orderBy("first", "order_id").first().order_id
    late = (F.col("order_id") == order) & created
    root = published(spark, f"{tmp_path}/marts", whole.filter(~late))
    scanned = []
    daily = sales.daily_sales
    monkeypatch.setattr(incremental.sales, "daily_sales", lambda *a: scanned.append(a[0]) or daily(*a))
    days = incremental.refresh_sales(spark, events, events.filter(late), root)
    of_order = {row[0] for row in events.filter(F.col("order_id") == order).select("event_date").collect()}
    assert set(days) == of_order
    assert values(build.read_mart_files(spark, root, "mart_daily_sales")) == values(daily(events))
    scans = scans_of(scanned[0], "order_id")
    assert scans and all("event_date" in s and (" IN (" in s or " INSET " in s) for s in scans)


def test_a_refresh_derives_order_events_and_their_days_once(spark, monkeypatch):
    """Not once for every mart and every write: what several jobs read is stored."""
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    root, staged = queries._published(spark, SMALL, before=queries.CUTOFF)
    assert "events.parquet" not in plan(staged) and "get_json_object" not in plan(staged)
    touched = {}
    write = incremental.write_slices

    def noted(table, root, contract, days=None):
        touched[contract.name] = plan(days)
        write(table, root, contract, days)

    monkeypatch.setattr(incremental, "write_slices", noted)
    incremental.refresh_sales(spark, staged, staged.filter(F.col("persisted_at") >= F.lit(CUTOFF)), root)
    assert "Join" not in touched["mart_daily_sales"] and "Join" not in touched["fct_order_events"]
    assert values(marts.read_mart_files(spark, root, "fct_order_events")) == values(orders.fct_order_events(staged))


def test_merged_rows_are_not_copied_by_an_aggregate(rows):
    schema = "k string, v int, x string"
    merged = incremental.merge_latest(rows([dict(k="a", v=1)], schema), rows([dict(k="a", v=2)], schema), ["k"], ["v"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2  # one before the shuffle


def test_health_is_derived_again_for_the_days_of_arrived_minutes(spark, tmp_path):
    minutes = staging.minute_metrics(log_metrics_minute(spark, SMALL))
    model = lambda rows: health.service_health(health.service_minute_metrics(rows))
    contract = CONTRACTS["mart_service_health"]
    hour = F.hour("metric_minute")
    marts.write_slices(model(minutes.filter(hour != 5)), f"{tmp_path}", contract)
    days = incremental.refresh_health(minutes, minutes.filter(hour == 5), f"{tmp_path}")
    assert len(days) == minutes.filter(hour == 5).select(F.to_date("metric_minute")).distinct().count()
    assert values(marts.read_mart_files(spark, f"{tmp_path}", contract.name)) == values(model(minutes))


def test_a_crash_at_any_step_of_a_merge_loses_nothing(spark, full_marts, events, monkeypatch):
    """Before the manifest readers see the old rows, whole; a repetition completes the change."""
    before = values(build.read_mart_files(spark, full_marts, "fct_orders"))
    changed = orders.fct_orders(events).limit(3).withColumns(
        {"order_event_count": F.col("order_event_count") + 100, "channel": F.lit("ios")}
    ).checkpoint()
    write = marts.write_table

    def torn(table, path, **options):
        write(table.limit(1), path, **options)
        raise RuntimeError("lost between files and manifest")

    with monkeypatch.context() as patch:
        patch.setattr(marts, "write_table", torn)
        with pytest.raises(RuntimeError, match="lost"):
            incremental.merge_into_mart(spark, changed, full_marts, "fct_orders", ["order_event_count"])
    assert values(build.read_mart_files(spark, full_marts, "fct_orders")) == before
    incremental.merge_into_mart(spark, changed, full_marts, "fct_orders", ["order_event_count"])
    found = build.read_mart_files(spark, full_marts, "fct_orders")
    assert found.count() == len(before)
    assert values(found.filter("order_event_count > 100")) == values(changed)
    contract = CONTRACTS["fct_orders"]
    newest = marts.manifest(spark, full_marts, contract).filter("file_version = 2")
    assert newest.count() <= 3 < marts.manifest(spark, full_marts, contract).count()
    whole = values(found)
    marts.vacuum(spark, full_marts, "fct_orders")
    assert values(build.read_mart_files(spark, full_marts, "fct_orders")) == whole
    marts.write_slices(found.limit(0), full_marts, contract)
    marts.vacuum(spark, full_marts, "fct_orders")
    assert build.read_mart_files(spark, full_marts, "fct_orders").count() == 0


def test_merge_latest_takes_the_highest_version(rows):
    schema = "k string, v int, x string"
    current = rows([dict(k="a", v=9, x="newest"), dict(k="b", v=1, x="kept"), dict(k="d", v=2, x="same")], schema)
    updates = rows([dict(k="a", v=1, x="old"), dict(k="a", v=2, x="older update"), dict(k="c", v=1, x="new"),
                    dict(k="d", v=2, x="replayed")], schema)
    assert values(incremental.merge_latest(current, updates, ["k"], ["v"])) == [
        ("a", 9, "newest"), ("b", 1, "kept"), ("c", 1, "new"), ("d", 2, "replayed")
    ]


def test_a_day_that_loses_all_rows_is_emptied(spark, full_marts, events):
    read = lambda name: build.read_mart_files(spark, full_marts, name)
    facts = orders.fct_order_events(events)
    day = facts.agg(F.min("event_date")).first()[0]
    moved = facts.filter(F.col("event_date") == day).withColumns({
        "event_date": F.date_add("event_date", 400),
        "event_sequence_number": F.col("event_sequence_number") + 1000,
    })
    incremental.merge_into_mart(spark, moved, full_marts, "fct_order_events", ["event_sequence_number"])
    found = read("fct_order_events")
    assert found.count() == facts.count() == found.select("event_id").distinct().count()
    assert found.filter(F.col("event_date") == day).count() == 0
    gone = read("mart_daily_sales").agg(F.min("event_date")).first()[0]
    shorter = sales.daily_sales(events).filter(F.col("event_date") > gone)
    incremental.replace_days(shorter, full_marts, "mart_daily_sales", gone, gone)
    assert read("mart_daily_sales").filter(F.col("event_date") == gone).count() == 0
    assert values(read("mart_daily_sales")) == values(shorter)


def test_bounded_reads(spark, full_marts):
    read = lambda *bounds: incremental.read_mart(spark, full_marts, "mart_service_health", *bounds)
    week = read(date(2024, 1, 1), date(2024, 1, 7))
    assert week.agg(F.max("metric_date")).first()[0] == date(2024, 1, 7)
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "(metric_date" in plan[plan.index("PartitionFilters: [") :].split("PushedFilters")[0]
    for bounds in [(), (date(2024, 1, 1), None), (date(2024, 1, 2), date(2024, 1, 1))]:
        with pytest.raises(incremental.ScanBoundError):
            read(*bounds)
    year = date(2024, 1, 1), date(2024, 12, 31)
    assert read(*year).count() > 0
    with pytest.raises(incremental.ScanBoundError, match="366 days requested, 7 allowed"):
        incremental.read_mart(spark, full_marts, "mart_service_health", *year, maximum_days=7)
    assert incremental.read_mart(spark, full_marts, "fct_orders").count() > 0


def test_backfill_is_bounded_and_late_rows_are_reported(spark, full_marts, events):
    daily = sales.daily_sales(events)
    incremental.backfill(daily, full_marts, "mart_daily_sales", date(2024, 1, 1), date(2024, 1, 3))
    assert values(build.read_mart_files(spark, full_marts, "mart_daily_sales")) == values(daily)
    with pytest.raises(incremental.ScanBoundError):
        incremental.backfill(daily, full_marts, "mart_daily_sales", date(2024, 1, 1), date(2024, 2, 1),
                             maximum_days=31)
    late = incremental.late_rows(events, MART_DAILY_SALES, date(2024, 1, 31))
    assert late.agg(F.max("event_date")).first()[0] == date(2024, 1, 23)
