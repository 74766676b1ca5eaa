"""Comparison of two catalog snapshots and classification of every change.

Inputs per snapshot
  columns: model, column, data_type, required, description
  models:  model, grain, contract_enforced, materialized, unique_key, owner, sla, tests
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Change types with their severity and classification.
CHANGES = {
    "published_model_removed": ("blocking", "breaking"),
    "published_column_removed": ("blocking", "breaking"),
    "published_column_rename": ("blocking", "breaking"),
    "incompatible_data_type_change": ("blocking", "breaking"),
    "nullable_to_required": ("blocking", "breaking"),
    "contract_removed": ("blocking", "breaking"),
    "grain_changed": ("blocking", "breaking"),
    "business_key_changed": ("blocking", "breaking"),
    "required_test_removed": ("blocking", "breaking"),
    "required_column_added": ("manual_review", "potentially_breaking"),
    "metric_description_changed": ("manual_review", "potentially_breaking"),
    "materialization_changed": ("manual_review", "potentially_breaking"),
    "incremental_key_changed": ("manual_review", "potentially_breaking"),
    "owner_changed": ("manual_review", "potentially_breaking"),
    "slo_changed": ("manual_review", "potentially_breaking"),
    "nullable_column_added": ("info", "non_breaking"),
}
METRIC_SUFFIXES = ("_count", "_amount", "_rate", "_ms")
KEY_TEST_PREFIXES = ("unique:", "unique_combination:")


def compare_contracts(
    old_models: DataFrame | None,
    new_models: DataFrame,
    old_columns: DataFrame | None,
    new_columns: DataFrame,
) -> DataFrame:
    """Findings (model, column, change_type, severity, classification, evidence).

    Models that exist only in the new snapshot yield nothing, and without an old snapshot (None)
    nothing is found. Every input is read once and shuffled once, by model: pairing the two sides
    and counting what came and went in a model both use that partitioning. A model's rows stream
    through a window, so a very wide model spills instead of filling memory. Of repeated rows of a
    model or column the least counts; a null name is a name of its own.
    """
    old_models = new_models.where(F.lit(False)) if old_models is None else old_models
    old_columns = new_columns.where(F.lit(False)) if old_columns is None else old_columns
    whole = Window.partitionBy("model")
    both = F.col("_in_old") & F.col("_in_new")
    pairs = (
        _paired(old_models, new_models, old_columns, new_columns)
        .withColumns({f"_model{side}": F.max(~F.col("_is_column") & F.col(side)).over(whole) for side in _SIDES})
        .withColumn("_kept", F.col("_model_in_old") & F.col("_model_in_new"))
    )
    findings = _exploded(
        _with_rename(pairs, whole), [*_model_changes(both), *_column_changes(both), _rename()]
    )
    severity = F.lit(None).cast("string")
    classification = F.lit(None).cast("string")
    for change, (level, kind) in CHANGES.items():
        matches = F.col("change_type") == change
        severity = F.when(matches, F.lit(level)).otherwise(severity)
        classification = F.when(matches, F.lit(kind)).otherwise(classification)
    return findings.select(
        "model",
        "column",
        "change_type",
        severity.alias("severity"),
        classification.alias("classification"),
        "evidence",
    )


def diff_status(findings: DataFrame, *, has_previous: bool = True) -> DataFrame:
    """One row: blocked if any finding blocks, with counts per severity.

    Without a previous snapshot the comparison says so instead of passing.
    """
    compared = F.when(F.col("blocking_count") > 0, F.lit("blocked")).otherwise(F.lit("passed"))
    return findings.agg(
        F.count_if(F.col("severity") == "blocking").alias("blocking_count"),
        F.count_if(F.col("severity") == "manual_review").alias("manual_review_count"),
        F.count_if(F.col("severity") == "info").alias("info_count"),
    ).withColumn(
        "status",
        compared if has_previous else F.lit("previous_state_unavailable"),
    )


_SIDES = ("_in_old", "_in_new")
_MODEL_FIELDS = ("grain", "contract_enforced", "materialized", "unique_key", "owner", "sla", "tests")
_COLUMN_FIELDS = ("data_type", "required", "description")


def _paired(
    old_models: DataFrame, new_models: DataFrame, old_columns: DataFrame, new_columns: DataFrame
) -> DataFrame:
    """A row per model and per column with both versions of its fields, partitioned by model."""

    def side(table: DataFrame, prefix: str, is_column: bool) -> DataFrame:
        fields = F.struct(*(_COLUMN_FIELDS if is_column else _MODEL_FIELDS))
        return table.select(
            "model",
            F.lit(is_column).alias("_is_column"),
            (F.col("column") if is_column else F.lit(None).cast("string")).alias("column"),
            fields.alias(f"_{prefix}_{'column' if is_column else 'model'}"),
        )

    rows = side(old_models, "old", False)
    for other in (
        side(new_models, "new", False),
        side(old_columns, "old", True),
        side(new_columns, "new", True),
    ):
        rows = rows.unionByName(other, allowMissingColumns=True)
    versions = [f"_{prefix}_{kind}" for prefix in ("old", "new") for kind in ("model", "column")]
    merged = (
        rows.repartition("model")
        .groupBy("model", "_is_column", "column")
        .agg(*(F.min(version).alias(version) for version in versions))
    )
    fields = [
        F.col(f"_{prefix}_{kind}.{name}").alias(f"{prefix}_{name}")
        for prefix in ("old", "new")
        for kind, names in (("model", _MODEL_FIELDS), ("column", _COLUMN_FIELDS))
        for name in names
    ]
    present = [
        (F.col(f"_{prefix}_model").isNotNull() | F.col(f"_{prefix}_column").isNotNull()).alias(f"_in_{prefix}")
        for prefix in ("old", "new")
    ]
    return merged.select("model", "_is_column", "column", *fields, *present)


def _finding(change: str, column: Column, *evidence: Column) -> Column:
    return F.struct(
        column.cast("string").alias("column"),
        F.lit(change).alias("change_type"),
        F.array(*evidence).alias("evidence"),
    )


def _exploded(rows: DataFrame, findings: list[Column]) -> DataFrame:
    """At most one finding per rule and row; the array has a fixed number of entries."""
    return rows.select(
        "model", F.explode(F.array_compact(F.array(*findings))).alias("_finding")
    ).select("model", "_finding.column", "_finding.change_type", "_finding.evidence")


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("none"))


def _previous(value: Column) -> Column:
    return F.concat(F.lit("previous="), _shown(value))


def _current(value: Column) -> Column:
    return F.concat(F.lit("current="), _shown(value))


def _model_changes(both: Column) -> list[Column]:
    """Rules over the row of a model."""
    nothing = F.lit(None)
    is_model = ~F.col("_is_column")
    kept = is_model & both

    def changed(name: str, change: str, compare: Callable[[Column], Column] = lambda c: c):
        old, new = compare(F.col(f"old_{name}")), compare(F.col(f"new_{name}"))
        return F.when(
            kept & ~old.eqNullSafe(new), _finding(change, nothing, _previous(old), _current(new))
        )

    def grain(description: Column) -> Column:
        return F.trim(F.substring_index(F.coalesce(description, F.lit("")), ".", 1))

    def keys(tests: Column) -> Column:
        is_key = lambda test: F.exists(
            F.array(*[F.lit(prefix) for prefix in KEY_TEST_PREFIXES]), test.startswith
        )
        chosen = F.filter(F.coalesce(tests, F.array().cast("array<string>")), is_key)
        return F.array_join(F.array_sort(F.array_distinct(chosen)), ", ")

    empty = F.array().cast("array<string>")
    lost_tests = F.array_sort(
        F.array_except(F.coalesce("old_tests", empty), F.coalesce("new_tests", empty))
    )
    enforced_before = F.coalesce("old_contract_enforced", F.lit(False))
    enforced_now = F.coalesce("new_contract_enforced", F.lit(False))
    return [
        F.when(
            is_model & ~F.col("_in_new"),
            _finding("published_model_removed", nothing, F.lit("model exists before only")),
        ),
        F.when(
            kept & enforced_before & ~enforced_now,
            _finding(
                "contract_removed", nothing, F.lit("contract was enforced and is not now")
            ),
        ),
        changed("grain", "grain_changed", grain),
        changed("tests", "business_key_changed", keys),
        F.when(
            kept & (F.size(lost_tests) > 0),
            F.struct(
                nothing.cast("string").alias("column"),
                F.lit("required_test_removed").alias("change_type"),
                lost_tests.alias("evidence"),
            ),
        ),
        changed("materialized", "materialization_changed"),
        changed("unique_key", "incremental_key_changed"),
        changed("owner", "owner_changed"),
        changed("sla", "slo_changed"),
    ]


def _type_of(side: str) -> Column:
    return F.lower(F.coalesce(F.col(f"{side}_data_type"), F.lit("")))


def _with_rename(pairs: DataFrame, whole: WindowSpec) -> DataFrame:
    """What came and went per model; ``_renamed`` if exactly one column of each did, of one type."""
    went = F.col("_kept") & F.col("_is_column") & ~F.col("_in_new")
    came = F.col("_kept") & F.col("_is_column") & ~F.col("_in_old")
    counted = pairs.withColumns({"_went": went, "_came": came}).withColumns(
        {
            "_removed": F.count_if("_went").over(whole),
            "_added": F.count_if("_came").over(whole),
            "_from": F.min(F.when(F.col("_went"), F.col("column"))).over(whole),
            "_to": F.min(F.when(F.col("_came"), F.col("column"))).over(whole),
            "_from_type": F.min(F.when(F.col("_went"), _type_of("old"))).over(whole),
            "_to_type": F.min(F.when(F.col("_came"), _type_of("new"))).over(whole),
        }
    )
    one_each = (F.col("_removed") == 1) & (F.col("_added") == 1)
    same_type = (F.col("_from_type") != "") & (F.col("_from_type") == F.col("_to_type"))
    return counted.withColumn("_renamed", F.coalesce(one_each & same_type, F.lit(False)))


def _rename() -> Column:
    """The rename of a model, found on the model's own row."""
    return F.when(
        F.col("_renamed") & ~F.col("_is_column"),
        _finding(
            "published_column_rename",
            F.concat_ws(" -> ", "_from", "_to"),
            F.lit("one column removed and one of the same type added"),
        ),
    )


def _column_changes(both: Column) -> list[Column]:
    """Rules over the row of a column of a model that both snapshots have."""

    def required(side: str) -> Column:
        return F.coalesce(F.col(f"{side}_required"), F.lit(False))

    def description(side: str) -> Column:
        return F.trim(F.coalesce(F.col(f"{side}_description"), F.lit("")))

    name = F.col("column")
    stays = F.col("_kept") & F.col("_is_column") & both
    removed = F.col("_went") & ~F.col("_renamed")
    added = F.col("_came") & ~F.col("_renamed")
    is_metric = F.lit(False)
    for suffix in METRIC_SUFFIXES:
        is_metric = is_metric | name.endswith(suffix)
    return [
        F.when(removed, _finding("published_column_removed", name, F.lit("column exists before only"))),
        F.when(
        added & required("new"),
        _finding("required_column_added", name, F.lit("column exists now only")),
        ),
        F.when(
        added & ~required("new"),
        _finding("nullable_column_added", name, F.lit("column exists now only")),
        ),
        F.when(
        stays & (_type_of("old") != _type_of("new")),
        _finding(
            "incompatible_data_type_change",
            name,
            _previous(_type_of("old")),
            _current(_type_of("new")),
        ),
        ),
        F.when(
        stays & ~required("old") & required("new"),
        _finding("nullable_to_required", name, F.lit("values are required now")),
        ),
        F.when(
        stays & is_metric & (description("old") != description("new")),
        _finding("metric_description_changed", name, F.lit("text changed; review the meaning")),
        ),
    ]
