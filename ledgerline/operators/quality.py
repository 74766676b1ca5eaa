"""Data-quality checks. Each returns the violating rows or keys; an empty result passes.

Grouped checks aggregate with map-side partial results, so a key with very many rows is
counted in parallel and never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import Contract

# Status spellings per class, and the statuses that pass a gate.
FAIL_STATUSES = ("error", "fail", "runtime error")
PASS_STATUSES = ("pass", "success")
GATE_STATUSES = ("passed", "pass", "warn")


# --- conditions a single row can break --------------------------------------------------


def is_missing(column: str) -> Column:
    return F.col(column).isNull()


def not_accepted(column: str, values: Sequence[str], where: str | None = None) -> Column:
    outside = ~F.col(column).isin(*values)
    return outside if where is None else F.expr(where) & outside


def missing_when(column: str, condition: str) -> Column:
    return F.expr(condition) & F.col(column).isNull()


def not_positive(column: str) -> Column:
    return F.col(column) <= 0


def is_negative(column: str) -> Column:
    return F.col(column) < 0


def counts_differ() -> Column:
    parts = F.col("success_count") + F.col("client_error_count") + F.col("server_error_count")
    return parts != F.col("request_count")


# --- violations -------------------------------------------------------------------------


def not_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(is_missing(column))


def unique(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; NULLs are ignored."""
    return unique_combination(rows.filter(F.col(column).isNotNull()), [column])


def accepted_values(
    rows: DataFrame, column: str, values: Sequence[str], where: str | None = None
) -> DataFrame:
    """Rows outside the accepted values; NULL passes."""
    return rows.filter(not_accepted(column, values, where))


def conditional_not_null(rows: DataFrame, column: str, condition: str) -> DataFrame:
    return rows.filter(missing_when(column, condition))


def positive_when_present(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(not_positive(column))


def non_negative(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(is_negative(column))


def count_consistency(rows: DataFrame) -> DataFrame:
    """Rows whose outcome counters do not add up to the request count."""
    return rows.filter(counts_differ())


def unique_combination(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once; NULL parts are equal to each other."""
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.filter("_rows > 1").drop("_rows")


def single_value_per_group(rows: DataFrame, column: str, group_by: str) -> DataFrame:
    """Groups with more than one distinct non-NULL value.

    More than one distinct value means least and greatest differ, which needs no distinct set.
    """
    spread = rows.groupBy(group_by).agg(
        F.min(column).alias("_least"), F.max(column).alias("_greatest")
    )
    return spread.filter("_least <> _greatest").select(group_by)


def single_partition_per_order(rows: DataFrame) -> DataFrame:
    """Orders spread over more than one Kafka topic partition."""
    placed = rows.withColumn("_place", F.struct("kafka_topic", "kafka_partition"))
    return single_value_per_group(placed, "_place", "order_id")


def single_user_per_order(rows: DataFrame) -> DataFrame:
    return single_value_per_group(rows, "user_id", "order_id")


def single_currency_per_order(rows: DataFrame) -> DataFrame:
    return single_value_per_group(rows, "currency", "order_id")


def coordinate_unique(rows: DataFrame) -> DataFrame:
    return unique_combination(rows, ["kafka_topic", "kafka_partition", "kafka_offset"])


def freshness(
    rows: DataFrame,
    loaded_at: str,
    as_of: datetime | Column,
    warn_minutes: int = 30,
    error_minutes: int = 120,
) -> DataFrame:
    """One row: newest load time and its status at the given clock; no rows is an error."""
    clock = as_of if isinstance(as_of, Column) else F.lit(as_of)
    latest = rows.agg(F.max(loaded_at).alias("max_loaded_at"))
    age = F.unix_micros(clock) - F.unix_micros("max_loaded_at")

    def older_than(minutes: int) -> Column:
        return age > minutes * 60_000_000

    return latest.select(
        "max_loaded_at",
        F.when(F.col("max_loaded_at").isNull() | older_than(error_minutes), F.lit("error"))
        .when(older_than(warn_minutes), F.lit("warn"))
        .otherwise(F.lit("pass"))
        .alias("status"),
    )


# --- declared test suites ---------------------------------------------------------------


@dataclass(frozen=True)
class KeyCheck:
    """A check of groups: ``broken`` is an aggregate that holds for a violating group of ``key``."""

    key: tuple[str, ...]
    broken: Column


def unique_key(column: str) -> KeyCheck:
    """No value twice; NULLs are ignored."""
    return KeyCheck((column,), F.count(column) > 1)


def unique_keys(columns: Sequence[str]) -> KeyCheck:
    """No combination twice; NULL parts are equal to each other."""
    return KeyCheck(tuple(columns), F.count(F.lit(1)) > 1)


def one_value(columns: Sequence[str], key: str) -> KeyCheck:
    """At most one distinct non-NULL value of each column per key."""
    spread = [F.coalesce(F.min(name) != F.max(name), F.lit(False)) for name in columns]
    return KeyCheck((key,), reduce(Column.__or__, spread))


@dataclass(frozen=True)
class Suite:
    """The checks declared on one table.

    ``row_checks`` map a name to the condition of a violating row; all of them are counted in
    one scan. ``key_checks`` map a name to a check of groups, of which all with one key share one
    scan, one shuffle and one aggregate, or to the violations of any other check.
    """

    table: str
    rows: DataFrame
    row_checks: dict[str, Column] = field(default_factory=dict)
    key_checks: dict[str, KeyCheck | DataFrame] = field(default_factory=dict)

    def violation_counts(self) -> DataFrame:
        """Rows (check_name, violation_count)."""
        parts = []
        if self.row_checks:
            parts.append(_counted(self.rows, self.row_checks))
        by_key: dict[tuple[str, ...], dict[str, Column]] = {}
        for name, check in self.key_checks.items():
            if isinstance(check, KeyCheck):
                by_key.setdefault(check.key, {})[name] = check.broken
            else:
                total = F.count(F.lit(1)).alias("violation_count")
                parts.append(check.agg(total).select(F.lit(name).alias("check_name"), "violation_count"))
        for key, checks in by_key.items():
            marks = [broken.alias(f"_broken{n}") for n, broken in enumerate(checks.values())]
            groups = self.rows.groupBy(*key).agg(*marks)
            parts.append(_counted(groups, {name: F.col(f"_broken{n}") for n, name in enumerate(checks)}))
        return reduce(DataFrame.unionByName, parts)


def _counted(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    counts = rows.agg(*[F.count_if(broken).alias(name) for name, broken in checks.items()])
    return counts.unpivot([], list(checks), "check_name", "violation_count")


def summarise(suites: Sequence[Suite]) -> DataFrame:
    """One row (table_name, check_name, violation_count, status) per declared check."""
    counts = reduce(
        DataFrame.unionByName,
        [
            suite.violation_counts().select(F.lit(suite.table).alias("table_name"), "*")
            for suite in suites
        ],
    )
    return counts.withColumn(
        "status", F.when(F.col("violation_count") == 0, F.lit("pass")).otherwise(F.lit("fail"))
    )


# --- contracts --------------------------------------------------------------------------


class ContractError(ValueError):
    """A mart does not have the published columns and types."""


def schema_differences(table: DataFrame, contract: Contract) -> list[str]:
    """Missing, unexpected, misplaced and mistyped columns, in words."""
    actual = {field.name: field.dataType for field in table.schema}
    expected = {field.name: field.dataType for field in contract.schema}
    found = [f"{name}: missing" for name in expected if name not in actual]
    found += [f"{name}: not in contract" for name in actual if name not in expected]
    found += [
        f"{name}: is {actual[name].simpleString()}, contract says {kind.simpleString()}"
        for name, kind in expected.items()
        if name in actual and actual[name] != kind
    ]
    if not found and list(actual) != list(expected):
        found.append("columns are out of order")
    return found


def enforce_schema(table: DataFrame, contract: Contract) -> DataFrame:
    """Return the table unchanged if its columns and types are those of the contract."""
    differences = schema_differences(table, contract)
    if differences:
        raise ContractError(f"{contract.name}: " + "; ".join(differences))
    return table


def enforce_contract(table: DataFrame, contract: Contract) -> DataFrame:
    """The table with its schema checked now and its required columns checked as it is written.

    A NULL in a required column fails the job that meets it, so no extra scan is needed and
    no such row is published.
    """
    enforce_schema(table, contract)

    def guarded(field) -> Column:
        if field.nullable:
            return F.col(field.name)
        problem = F.raise_error(F.lit(f"{contract.name}.{field.name} must not be NULL"))
        return F.coalesce(F.col(field.name), problem.cast(field.dataType)).alias(field.name)

    return table.select(*[guarded(field) for field in contract.schema])


def required_nulls(table: DataFrame, contract: Contract) -> DataFrame:
    """Rows (column_name, null_count) for required columns that hold NULLs; one scan.

    Requirements come from the contract: stored files do not keep nullability.
    """
    names = contract.required
    counts = table.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in names])
    return counts.unpivot([], names, "column_name", "null_count").filter("null_count > 0")


# --- results of checks as tables --------------------------------------------------------


def result_rollup(results: DataFrame, parents: DataFrame, assets: DataFrame) -> DataFrame:
    """Status counts and overall status per asset: fail over warn over pass over unknown.

    ``results``: unique_id, status. ``parents``: unique_id, asset_id. ``assets``: asset_id.
    """
    status = F.col("status")
    known = (*FAIL_STATUSES, *PASS_STATUSES, "warn")
    # Counted per test and status first, so a test with very many results joins as few rows.
    counted = results.groupBy(
        "unique_id", F.coalesce("status", F.lit("unknown")).alias("status")
    ).agg(F.count(F.lit(1)).alias("_results"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_results")).otherwise(F.lit(0)))

    counts = (
        counted.join(parents, "unique_id")
        .groupBy("asset_id")
        .agg(
            total(status.isin(*FAIL_STATUSES)).alias("fail_count"),
            total(status == "warn").alias("warn_count"),
            total(status.isin(*PASS_STATUSES)).alias("pass_count"),
            total(~status.isin(*known)).alias("other_count"),
        )
    )
    names = ("fail_count", "warn_count", "pass_count", "other_count")
    joined = assets.select("asset_id").join(counts, "asset_id", "left").fillna(0, list(names))
    overall = (
        F.when(F.col("fail_count") > 0, F.lit("fail"))
        .when(F.col("warn_count") > 0, F.lit("warn"))
        .when(F.col("pass_count") > 0, F.lit("pass"))
        .otherwise(F.lit("unknown"))
    )
    return joined.withColumn("quality_status", overall)


def gate(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether every status passes. An empty input passes."""
    passed = F.coalesce(F.col("status").isin(*GATE_STATUSES), F.lit(False))
    return results.groupBy(*by).agg(F.coalesce(F.bool_and(passed), F.lit(True)).alias("passed"))


def changed_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys (with multiplicity) present on one side only: a source must come out unchanged.

    Copies are counted per key before the comparison, so a key with many copies is one row.
    """
    sides = before.select(*keys, F.lit(1).alias("_delta")).unionByName(
        after.select(*keys, F.lit(-1).alias("_delta"))
    )
    return (
        sides.groupBy(*keys)
        .agg(F.sum("_delta").alias("rows_lost"))
        .filter("rows_lost <> 0")
    )
