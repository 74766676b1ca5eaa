"""Cost policy over tables of query estimates and of policy thresholds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Thresholds in bytes per model; the default row serves all other models.
DEFAULT_MODEL = "default"
PARTITION_FILTER_EXEMPT = "fct_orders"
POLICY_COLUMNS = "model string, warning_threshold_bytes bigint, blocking_threshold_bytes bigint, cost_class string"
POLICY = [
    ("default", 536870912, 1073741824, "default"),
    ("mart_daily_sales", 268435456, 536870912, "medium"),
    ("mart_service_health", 134217728, 268435456, "low"),
    ("fct_order_events", 536870912, 1073741824, "high"),
    ("fct_orders", 134217728, 268435456, "low_lookup"),
]

WAIVER_COLUMNS = (
    "waiver_owner",
    "waiver_reason",
    "waiver_expires_at",
    "waiver_approved_bytes",
)


def default_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, POLICY_COLUMNS)


def invalid_policies(policy: DataFrame) -> DataFrame:
    """Policy rows that break 0 < warning < blocking or lack a cost class."""
    ordered = (F.col("warning_threshold_bytes") > 0) & (
        F.col("blocking_threshold_bytes") > F.col("warning_threshold_bytes")
    )
    named = F.length(F.trim(F.coalesce("cost_class", F.lit("")))) > 0
    return policy.filter(~F.coalesce(ordered & named, F.lit(False)))


def utc_expiry(text: Column) -> Column:
    """Instant of an ISO text that ends in Z; NULL otherwise."""
    return F.when(text.endswith("Z"), F.try_to_timestamp(text))


def _filled(column: str) -> Column:
    return F.length(F.trim(F.coalesce(column, F.lit("")))) > 0


def evaluate_costs(estimates: DataFrame, policy: DataFrame, now: datetime | Column) -> DataFrame:
    """Decision (pass, warn, block, invalid) and findings for every query estimate.

    ``estimates``: query_id, model, valid, total_bytes_processed, partition_filter_present,
    requested_scan_window_days, maximum_scan_window_days, has_waiver, and the waiver columns.
    A missing or negative estimate is invalid, never zero. The policy has one row per model and joins by
    model name; where none matches, the default row's values apply.
    """
    clock = now if isinstance(now, Column) else F.lit(now)
    thresholds = ("warning_threshold_bytes", "blocking_threshold_bytes", "cost_class")
    own = policy.select("model", *[F.col(name).alias(f"_own_{name}") for name in thresholds])
    default = policy.filter(F.col("model") == DEFAULT_MODEL)
    rows = estimates.join(own, "model", "left").withColumns(
        {
            name: F.coalesce(F.col(f"_own_{name}"), default.select(name).scalar())
            for name in thresholds
        }
    )
    estimate = F.col("total_bytes_processed")
    approved = F.when(
        F.col("has_waiver") & (F.col("waiver_approved_bytes") > 0), F.col("waiver_approved_bytes")
    )
    requested, maximum = F.col("requested_scan_window_days"), F.col("maximum_scan_window_days")
    requested_ok = F.coalesce(requested > 0, F.lit(False))
    maximum_ok = F.coalesce(maximum > 0, F.lit(False))
    expiry = utc_expiry(F.col("waiver_expires_at"))
    waived = F.coalesce(F.col("has_waiver"), F.lit(False))
    waiver_defects = {
        "waiver-owner": waived & ~_filled("waiver_owner"),
        "waiver-reason": waived & ~_filled("waiver_reason"),
        "waiver-expiry": waived & expiry.isNull(),
        "waiver-expired": waived & F.coalesce(expiry <= clock, F.lit(False)),
        "waiver-threshold-missing": waived & approved.isNull(),
    }
    defective = F.lit(False)
    for defect in waiver_defects.values():
        defective = defective | defect
    within_waiver = F.coalesce(~defective & (estimate <= approved), F.lit(False))
    blocks = F.coalesce(estimate >= F.col("blocking_threshold_bytes"), F.lit(False))
    warns = F.coalesce(estimate >= F.col("warning_threshold_bytes"), F.lit(False))
    is_valid = F.coalesce(F.col("valid"), F.lit(False))
    negative = F.coalesce(estimate < 0, F.lit(False))
    filtered = F.coalesce(F.col("partition_filter_present"), F.lit(False))
    errors = {
        "fixture-validity": ~is_valid,
        "missing-estimate": estimate.isNull(),
        "negative-estimate": negative,
        "partition-filter": (F.col("model") != PARTITION_FILTER_EXEMPT) & ~filtered,
        "scan-window-requested": ~requested_ok,
        "scan-window-maximum": ~maximum_ok,
        "scan-window-exceeded": maximum_ok & F.coalesce(requested > maximum, F.lit(False)),
        **waiver_defects,
        "blocking-threshold": blocks & ~within_waiver,
        "waiver-threshold": F.coalesce(estimate > approved, F.lit(False)),
    }
    warnings = {"warning-threshold": warns & ~blocks & ~within_waiver}
    notes = {"waiver-applied": within_waiver & blocks}

    def names(findings: dict[str, Column]) -> Column:
        return F.array_compact(
            F.array(*[F.when(holds, F.lit(name)) for name, holds in findings.items()])
        )

    evaluated = rows.withColumns(
        {
            "errors": names(errors),
            "warnings": names(warnings),
            "waiver_applied": notes["waiver-applied"],
        }
    )
    decision = (
        F.when(~is_valid | estimate.isNull() | negative, F.lit("invalid"))
        .when(F.size("errors") > 0, F.lit("block"))
        .when(F.size("warnings") > 0, F.lit("warn"))
        .otherwise(F.lit("pass"))
    )
    return evaluated.select(
        "query_id",
        "model",
        decision.alias("decision"),
        estimate.alias("estimated_bytes"),
        *thresholds,
        "errors",
        "warnings",
        "waiver_applied",
    )


def loosened_thresholds(
    previous: DataFrame, current: DataFrame, waivers: DataFrame, now: datetime | Column
) -> DataFrame:
    """Models whose blocking threshold rose; a live waiver that covers it turns it into info.

    ``previous`` and ``current``: model, blocking_threshold_bytes. ``waivers``: model and the
    waiver columns.
    """
    clock = now if isinstance(now, Column) else F.lit(now)
    old = previous.select("model", F.col("blocking_threshold_bytes").alias("previous_bytes"))
    new = current.select("model", F.col("blocking_threshold_bytes").alias("current_bytes"))
    raised = old.join(new, "model").filter("current_bytes > previous_bytes")
    covered = F.coalesce(
        _filled("waiver_owner")
        & _filled("waiver_reason")
        & (utc_expiry(F.col("waiver_expires_at")) > clock)
        & (F.col("waiver_approved_bytes") >= F.col("current_bytes")),
        F.lit(False),
    )
    return raised.join(waivers.select("model", *WAIVER_COLUMNS), "model", "left").select(
        "model",
        F.when(covered, F.lit("blocking_threshold_loosened_with_waiver"))
        .otherwise(F.lit("blocking_threshold_loosened"))
        .alias("change_type"),
        F.when(covered, F.lit("info")).otherwise(F.lit("blocking")).alias("severity"),
        F.when(covered, F.lit("potentially_breaking"))
        .otherwise(F.lit("breaking"))
        .alias("classification"),
        "previous_bytes",
        "current_bytes",
    )
