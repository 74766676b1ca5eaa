"""Daily sales by UTC date, currency and creation channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import safe_divide
from ledgerline.plans.orders import STREAM_ORDER, is_type
from ledgerline.schemas import MART_DAILY_SALES, MONEY

_COUNTS = {
    "_created": "order_created",
    "_paid": "order_paid",
    "_cancelled": "order_cancelled",
    "_failed": "payment_failed",
}
_AMOUNTS = {
    "_created_amount": "order_created",
    "_paid_amount": "order_paid",
    "_failed_amount": "payment_failed",
}
_ORDER_DAY = ["order_id", "event_date", "_own_currency", "_is_cancellation"]


def daily_sales(events: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Aggregate order activity per (date, currency, channel).

    Step one reduces events to one row per order, day, own currency and cancellation flag
    (hash aggregate with map-side partial results). At most one row per order then reaches
    each output group for each count, so distinct-order counts become sums and no row is
    expanded. A cancelled event takes its order's creation currency, which is why its own
    currency is left out of the step-one key. Step two attaches the creation currency and
    channel to the reduced rows, so the join never sees a hot order's events; they come from
    ``orders`` when that fact is given, otherwise from the creation events alone. Step three
    rolls up.
    """
    keyed = events.withColumns(
        {
            "_is_cancellation": is_type("order_cancelled"),
            "_own_currency": F.when(~is_type("order_cancelled"), F.col("currency")),
        }
    )
    order_days = keyed.groupBy(*_ORDER_DAY).agg(
        *[F.count_if(is_type(kind)).alias(name) for name, kind in _COUNTS.items()],
        *[
            F.sum(F.when(is_type(kind), F.col("amount"))).alias(name)
            for name, kind in _AMOUNTS.items()
        ],
    )
    facts = creation_facts(events) if orders is None else orders
    attributed = order_days.join(
        facts.select(
            "order_id",
            F.col("currency").alias("_order_currency"),
            F.col("channel").alias("_channel"),
        ),
        "order_id",
        "left",
    )
    return _roll_up(attributed)


def creation_facts(events: DataFrame) -> DataFrame:
    """Currency and channel of each order's first creation event."""
    first = F.min(F.struct(*STREAM_ORDER, "currency", "channel")).alias("_creation")
    return (
        events.filter(is_type("order_created"))
        .groupBy("order_id")
        .agg(first)
        .select("order_id", "_creation.currency", "_creation.channel")
    )


def _roll_up(attributed: DataFrame) -> DataFrame:
    def orders_with(name: str):
        return F.count_if(F.col(name) > 0)

    def amount(name: str):
        return F.coalesce(F.sum(name), F.lit(0)).cast(MONEY)

    currency = F.when(F.col("_is_cancellation"), F.col("_order_currency")).otherwise(
        F.col("_own_currency")
    )
    return (
        attributed.groupBy(
            "event_date", currency.alias("currency"), F.col("_channel").alias("channel")
        )
        .agg(
            orders_with("_created").alias("created_order_count"),
            amount("_created_amount").alias("created_order_amount"),
            orders_with("_paid").alias("paid_order_count"),
            amount("_paid_amount").alias("paid_amount"),
            orders_with("_cancelled").alias("cancelled_order_count"),
            orders_with("_failed").alias("payment_failed_order_count"),
            amount("_failed_amount").alias("payment_failed_amount"),
            F.sum(F.col("_paid") + F.col("_failed")).alias("payment_attempt_count"),
            F.sum("_paid").alias("_payment_success_count"),
        )
        .withColumn(
            "payment_success_rate",
            safe_divide("_payment_success_count", "payment_attempt_count"),
        )
        .select(*MART_DAILY_SALES.columns)
    )
