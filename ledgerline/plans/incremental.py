"""Incremental maintenance and bounded reading of published marts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.plans import health, orders, sales
from ledgerline.plans.marts import manifest, read_mart_files, read_slices, with_slice, write_slices
from ledgerline.schemas import CONTRACTS, Contract
from ledgerline.session import stored


class ScanBoundError(ValueError):
    """A mart read without both bounds, or over more days than its policy allows."""


def between_dates(column: str, start: date, end: date) -> Column:
    return (F.col(column) >= F.lit(start)) & (F.col(column) <= F.lit(end))


def lookback_start(contract: Contract, as_of: date) -> date:
    return as_of - timedelta(days=contract.lookback_days)


def refresh_recent(full_model: DataFrame, root: str, name: str, as_of: date) -> None:
    """Recompute the lookback window ``[as_of - lookback, as_of]`` and replace those days.

    ``full_model`` must be the model over all events: a cancellation is attributed through
    its order's creation, which may lie before the window. Only the output is limited.
    """
    contract = CONTRACTS[name]
    replace_days(full_model, root, name, lookback_start(contract, as_of), as_of)


def backfill(
    full_model: DataFrame,
    root: str,
    name: str,
    start: date,
    end: date,
    *,
    maximum_days: int | None = None,
) -> None:
    """Manual rebuild of the days ``[start, end]``, of at most ``maximum_days`` if given."""
    _check_window(CONTRACTS[name], start, end, maximum_days)
    replace_days(full_model, root, name, start, end)


def replace_days(full_model: DataFrame, root: str, name: str, start: date, end: date) -> None:
    """Replace the day slices of the range; days without rows any more leave the mart."""
    contract = CONTRACTS[name]
    if contract.partition_column is None:
        raise ValueError(f"{name} is not partitioned by day; merge it by key")
    chosen = between_dates(contract.partition_column, start, end)
    held = manifest(full_model.sparkSession, root, contract).filter(chosen)
    write_slices(full_model.filter(chosen), root, contract, held)


def refresh_sales(spark: SparkSession, events: DataFrame, arrived: DataFrame, root: str) -> list[date]:
    """Bring the order facts and daily sales up to date with newly ``arrived`` events.

    ``events`` are all staged events, arrived ones included; only those of touched orders are
    used. The facts are merged by key first. An order whose creation currency or channel has
    changed may change every day on which it has events, other orders only the days of their
    arrived events; sales are then derived again from the stored facts of these days, however
    old they are, and the scan of the event fact is limited to their folders. Returns the days.
    """
    touched = arrived.select("order_id").distinct()
    history = stored(events.join(touched, "order_id", "left_semi"), dictionaries=False)
    facts = stored(orders.fct_orders(history))
    known = _in_touched_slices(spark, facts, root, CONTRACTS["fct_orders"])
    same = [F.col(f"new.{name}").eqNullSafe(F.col(f"old.{name}")) for name in ("currency", "channel")]
    moved = (
        facts.alias("new")
        .join(known.alias("old"), F.col("new.order_id") == F.col("old.order_id"), "left")
        .filter(~(same[0] & same[1]))
        .select("new.order_id")
    )
    days = history.join(moved, "order_id", "left_semi").select("event_date")
    days = stored(days.unionByName(arrived.select("event_date")).distinct())
    merge_into_mart(spark, orders.fct_order_events(history), root, "fct_order_events", ["persisted_at"])
    merge_into_mart(spark, facts, root, "fct_orders", ["order_event_count"])
    # bounded by the calendar; as literals they prune the folders of the scan
    chosen = sorted(row[0] for row in days.collect())
    if chosen:
        of_days = read_mart_files(spark, root, "fct_order_events").filter(F.col("event_date").isin(chosen))
        daily = sales.daily_sales(of_days, read_mart_files(spark, root, "fct_orders"))
        write_slices(daily, root, CONTRACTS["mart_daily_sales"], days)
    return chosen


def refresh_health(minutes: DataFrame, arrived: DataFrame, root: str) -> list[date]:
    """Derive service health again for the days of the ``arrived`` minutes, however old.

    ``minutes`` is the staged minute table and ``arrived`` those of its rows that are new or
    changed (column metric_minute). Bounds on the minute reach the scan, and only the days'
    minutes are aggregated. Returns the days.
    """
    day = F.to_date("metric_minute").alias("metric_date")
    days = arrived.select(day).distinct()
    chosen = sorted(row[0] for row in days.collect())  # bounded by the calendar
    if chosen:
        after = chosen[-1] + timedelta(days=1)
        bounds = (F.col("metric_minute") >= F.lit(chosen[0])) & (F.col("metric_minute") < F.lit(after))
        of_days = minutes.filter(bounds).filter(F.to_date("metric_minute").isin(chosen))
        model = health.service_health(health.service_minute_metrics(of_days))
        write_slices(model, root, CONTRACTS["mart_service_health"], days)
    return chosen


def _in_touched_slices(
    spark: SparkSession, updates: DataFrame, root: str, contract: Contract
) -> DataFrame:
    """Published rows of the key buckets that the updates fall into."""
    buckets = with_slice(updates.select(*contract.unique_key), contract).select("key_bucket").distinct()
    return read_slices(spark, root, contract).join(buckets, "key_bucket", "left_semi").select(*contract.columns)


def late_rows(new_rows: DataFrame, contract: Contract, as_of: date) -> DataFrame:
    """Rows per day that arrived for days before the lookback window: backfill candidates."""
    column = contract.partition_column or "event_date"
    return (
        new_rows.filter(F.col(column) < F.lit(lookback_start(contract, as_of)))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("late_row_count"))
    )


def merge_latest(
    current: DataFrame, updates: DataFrame, key: Sequence[str], version: Sequence[str]
) -> DataFrame:
    """Keyed merge: every key takes its row of the highest version.

    One window over the union instead of an anti-join: the highest version wins wherever it
    comes from, an update wins over a current row of its version, and copies collapse map-side,
    where Spark keeps the first row of a key. Rows stay as they are; no aggregate copies them.
    """
    columns = current.columns
    rest = [name for name in columns if name not in key and name not in version]
    ranked = current.withColumn("_rank", F.lit(0)).unionByName(
        updates.select(*columns).withColumn("_rank", F.lit(1))
    )
    newest_first = Window.partitionBy(*key).orderBy(*[F.desc(x) for x in [*version, "_rank", *rest]])
    return ranked.withColumn("_place", F.row_number().over(newest_first)).filter("_place = 1").select(*columns)


def merge_into_mart(
    spark: SparkSession, updates: DataFrame, root: str, name: str, version: Sequence[str]
) -> None:
    """Merge updated rows into a published mart by its unique key.

    Only slices that hold updates, or the rows they replace, are read and written: key buckets,
    or days where the mart has a day column. The change is published with its manifest.
    """
    contract = CONTRACTS[name]
    key, day = list(contract.unique_key), contract.partition_column
    if day is None:
        current = _in_touched_slices(spark, updates, root, contract)
        touched = with_slice(updates.select(*key), contract).select("key_bucket").distinct()
    else:
        published = read_mart_files(spark, root, name)
        # by hash: a day named for an equal hash of another key is only written again as it is
        hashed = F.xxhash64(*key).alias("_key")
        replaced = published.select(day, hashed).join(updates.select(hashed), "_key", "left_semi").select(day)
        touched = stored(replaced.unionByName(updates.select(day)).distinct())
        current = published.join(touched, day, "left_semi").select(*contract.columns)
    write_slices(merge_latest(current, updates, key, version), root, contract, touched)


def read_mart(
    spark: SparkSession,
    root: str,
    name: str,
    start: date | None = None,
    end: date | None = None,
    *,
    maximum_days: int | None = None,
) -> DataFrame:
    """Read a mart within date bounds; the filter prunes day folders.

    A partitioned mart needs both bounds. ``maximum_days`` refuses longer ranges, for instance
    by the ``maximum_scan_days`` of the mart's contract; by default any range is read.
    """
    contract = CONTRACTS[name]
    table = read_mart_files(spark, root, name)
    if contract.partition_column is None:
        return table
    if start is None or end is None:
        raise ScanBoundError(f"{name}: both date bounds are required")
    _check_window(contract, start, end, maximum_days)
    return table.filter(between_dates(contract.partition_column, start, end))


def _check_window(contract: Contract, start: date, end: date, maximum_days: int | None) -> None:
    days = (end - start).days + 1
    if days < 1:
        raise ScanBoundError(f"{contract.name}: the range is empty")
    if maximum_days is not None and days > maximum_days:
        raise ScanBoundError(f"{contract.name}: {days} days requested, {maximum_days} allowed")
