"""Decoding and validation of raw JSON events as Column expressions.

Every record gets an ``error_type`` (NULL when valid), an ``error_message`` made of field
names and rule names only, and the typed fields of its event. No row is dropped here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import (
    ACCESS_EVENT_TYPE,
    CHANNELS,
    CURRENCIES,
    ERROR_LOG_EVENT_TYPE,
    HTTP_METHODS,
    MONEY,
    ORDER_EVENT_TYPES,
)


# Characters of the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NUMBER_KINDS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|STRING)$"
_WHOLE_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"
_CANONICAL_UUID = r"^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
_OTHER_UUID = (
    r"^([0-9a-f]{32}"
    r"|urn:uuid:[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}"
    r"|\{[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}\})$"
)
_UUID_PARTS = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
_AWARE_TIME = (
    r"^\d{4}-\d{2}-\d{2}[T _]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"
)
_MONEY_LIMIT = 10**16  # numeric(18,2) holds sixteen digits before the point
_INT_LIMIT = 2**31


# --- one JSON value ---------------------------------------------------------------------


@dataclass(frozen=True)
class Value:
    """The kind and text of one JSON value, held in two columns computed once per record."""

    name: str

    @property
    def kind(self) -> Column:
        """Variant type name; NULL when the field is absent, VOID for a JSON null."""
        return F.col(f"_kind_{self.name}")

    @property
    def text(self) -> Column:
        return F.col(f"_text_{self.name}")

    @property
    def is_text(self) -> Column:
        return self.kind == "STRING"

    @property
    def is_absent(self) -> Column:
        return self.kind.isNull()

    @property
    def is_absent_or_null(self) -> Column:
        return self.kind.isNull() | (self.kind == "VOID")

    @property
    def stripped(self) -> Column:
        return F.btrim(self.text, F.lit(WHITE_SPACE))

    @property
    def number(self) -> Column:
        """Double of a JSON number or number-like text; NULL for anything else."""
        plain = self.kind.rlike(_NUMBER_KINDS) & self.text.rlike(_NUMBER)
        return F.when(plain, self.text.try_cast("double"))

    @property
    def whole(self) -> Column:
        """Whole number of a JSON number, boolean or digit text; NULL for anything else."""
        wide = self.text.try_cast("decimal(38,9)")
        digits = self.is_text & self.text.rlike(_WHOLE_TEXT)
        number = ~self.is_text & self.kind.rlike(_NUMBER_KINDS) & (wide == F.floor(wide))
        return F.when(self.kind == "BOOLEAN", (self.text == "true").cast("decimal(38,9)")).when(
            digits | number, wide
        )


def _hyphenated(digits: Column) -> Column:
    return F.regexp_replace(digits, _UUID_PARTS, "$1-$2-$3-$4-$5")


def normalised_uuid(text: Column) -> Column:
    """Canonical lower-case UUID, or NULL when the text is not a UUID."""
    lowered = F.lower(text)
    digits = F.regexp_replace(lowered, r"^urn:uuid:|[{}-]", "")
    return F.when(lowered.rlike(_CANONICAL_UUID), lowered).when(
        lowered.rlike(_OTHER_UUID), _hyphenated(digits)
    )


def lenient_uuid(text: Column) -> Column:
    """UUID of a quarantined record: braces, prefixes and stray hyphens are ignored."""
    digits = F.regexp_replace(F.lower(text), r"urn:|uuid:|-|^[{}]+|[{}]+$", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), _hyphenated(digits))


def aware_timestamp(text: Column) -> Column:
    """UTC instant of an ISO text with an offset; NULL for naive or malformed text."""
    upper = F.upper(text)
    with_t = F.regexp_replace(upper, "^(.{10})[ _]", "$1T")
    with_seconds = F.regexp_replace(with_t, r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")
    return F.when(upper.rlike(_AWARE_TIME), F.try_to_timestamp(with_seconds))


# --- rules ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A named check on one field; NULL or false means the rule is broken."""

    name: str
    holds: Callable[[Value], Column]
    optional: bool = False

    def message(self, location: str, field: Value) -> Column:
        passed = F.coalesce(self.holds(field), F.lit(False))
        if self.optional:
            passed = field.is_absent_or_null | passed
        return F.when(~passed, F.lit(f"{location}: {self.name}"))


def _one_of(allowed: Sequence[str]) -> Rule:
    return Rule(
        f"must be one of {', '.join(allowed)}",
        lambda field: field.is_text & field.text.isin(*allowed),
    )


def _filled(field: Value) -> Column:
    return field.is_text & (field.stripped != "")


def _starts_with_slash(field: Value) -> Column:
    return field.is_text & field.text.startswith("/")


TEXT = Rule("must be non-empty text", _filled)
OPTIONAL_TEXT = Rule("must be non-empty text", _filled, optional=True)
OPTIONAL_ANY_TEXT = Rule("must be text", lambda field: field.is_text, optional=True)
POSITIVE_WHOLE = Rule("must be a whole number above 0", lambda field: field.whole > 0)
NON_NEGATIVE_WHOLE = Rule("must be a whole number of at least 0", lambda field: field.whole >= 0)
STATUS_CODE = Rule(
    "must be a whole number from 100 to 599", lambda field: field.whole.between(100, 599)
)
POSITIVE_AMOUNT = Rule(
    "must be a number above 0",
    lambda field: (field.number > 0) & (field.number < float("inf")),
)
ENDPOINT = Rule("must start with /", _starts_with_slash)
OPTIONAL_ENDPOINT = Rule("must start with /", _starts_with_slash, optional=True)

_ORDER_BASE = {"order_id": TEXT, "user_id": TEXT}
_PAYMENT_BASE = {
    **_ORDER_BASE,
    "payment_id": TEXT,
    "amount": POSITIVE_AMOUNT,
    "currency": _one_of(CURRENCIES),
}

# The payload fields of each event type and the rule each must satisfy.
PAYLOAD_RULES: dict[str, dict[str, Rule]] = {
    "order_created": {
        **_ORDER_BASE,
        "product_id": TEXT,
        "quantity": POSITIVE_WHOLE,
        "amount": POSITIVE_AMOUNT,
        "currency": _one_of(CURRENCIES),
        "channel": _one_of(CHANNELS),
    },
    "order_paid": {**_PAYMENT_BASE, "payment_method": TEXT},
    "order_cancelled": {**_ORDER_BASE, "cancellation_reason": TEXT},
    "payment_failed": {**_PAYMENT_BASE, "failure_code": TEXT, "failure_reason": TEXT},
    ACCESS_EVENT_TYPE: {
        "request_id": TEXT,
        "service": TEXT,
        "endpoint": ENDPOINT,
        "http_method": _one_of(HTTP_METHODS),
        "status_code": STATUS_CODE,
        "response_time_ms": NON_NEGATIVE_WHOLE,
        "client_ip": TEXT,
    },
    ERROR_LOG_EVENT_TYPE: {
        "request_id": TEXT,
        "service": TEXT,
        "error_type": TEXT,
        "error_message": TEXT,
        "endpoint": OPTIONAL_ENDPOINT,
        "stack_trace": OPTIONAL_ANY_TEXT,
        "trace_id": OPTIONAL_TEXT,
    },
}
SCALAR_ENVELOPE_FIELDS = ("event_id", "event_type", "event_version", "event_time", "source")
ENVELOPE_FIELDS = (*SCALAR_ENVELOPE_FIELDS, "payload")

# Widths of the stored text columns.
TEXT_WIDTHS = {"order_id": 64, "user_id": 64, "product_id": 64, "service": 100, "endpoint": 255}
TOPIC_WIDTH = 255


@dataclass(frozen=True)
class Family:
    """The event types one consumer accepts."""

    name: str
    event_types: tuple[str, ...]
    default_type: str | None = None
    reject_other_types_as: str | None = None


ORDERS = Family("orders", ORDER_EVENT_TYPES)
ACCESS_LOGS = Family(
    "access logs",
    (ACCESS_EVENT_TYPE,),
    default_type=ACCESS_EVENT_TYPE,
    reject_other_types_as="UnsupportedEventType",
)
ALL_EVENTS = Family("all events", tuple(PAYLOAD_RULES))


# --- the decoder ------------------------------------------------------------------------


def decode(raw: DataFrame, family: Family) -> DataFrame:
    """Decode raw records and attach ``error_type``, ``error_message`` and typed fields.

    The rule expressions refer to columns by name only, so they are built once per family
    and reused by every micro-batch.
    """
    fields = _payload_fields(family)
    opened = _open_json(raw)
    read = opened.withColumns(
        {
            **_read_fields("_envelope", SCALAR_ENVELOPE_FIELDS, "e_"),
            **_read_fields("_payload", fields, "p_"),
        }
    )
    typed = read.withColumns(_typed_columns(family, fields))
    checked = typed.withColumns(
        {"_broken": _broken_rules(family), "_too_wide": _storage_violations(fields)}
    )
    verdict = checked.withColumns(_verdict(family))
    kept = [name for name in typed.columns if not name.startswith("_")]
    return _evaluated_once(verdict.select(*kept, "error_type", "error_message"))


@cache
def _read_fields(map_column: str, names: Sequence[str], prefix: str) -> dict[str, Column]:
    columns = {}
    for name in names:
        found = F.try_element_at(map_column, F.lit(name))
        columns[f"_kind_{prefix}{name}"] = F.schema_of_variant(found)
        columns[f"_text_{prefix}{name}"] = F.try_variant_get(found, "$", "string")
    return columns


def _envelope_value(name: str) -> Value:
    return Value(f"e_{name}")


def _payload_value(name: str) -> Value:
    return Value(f"p_{name}")


def _evaluated_once(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator.

    A later filter on ``error_type`` would otherwise be pushed below the projections, and its
    copy of every nested rule makes the plan explode. Filters do not move below a generator.
    """
    record = F.explode_outer(F.array(F.struct(*rows.columns))).alias("_record")
    return rows.select(record).select("_record.*")


def _payload_fields(family: Family) -> tuple[str, ...]:
    names: dict[str, None] = {}
    for event_type in family.event_types:
        names.update(dict.fromkeys(PAYLOAD_RULES[event_type]))
    return tuple(names)


def _open_json(raw: DataFrame) -> DataFrame:
    body = F.coalesce("value", F.lit(b"")).cast("string")
    # The parser stops after the first JSON value, so text behind it would go unnoticed.
    # Inside an object that ends with a key made from the text's own digest, anything but
    # exactly one value breaks the object or adds keys to it.
    wrapped = F.concat(
        F.lit('{"v":'), F.col("payload_text"), F.lit(',"'), F.md5("payload_text"), F.lit('":1}')
    )
    return (
        raw.withColumn("_utf8", F.is_valid_utf8(body))
        .withColumn("payload_text", F.when(F.col("_utf8"), body))
        .withColumn(
            "_wrapper", F.try_variant_get(F.try_parse_json(wrapped), "$", "map<string,variant>")
        )
        .withColumn(
            "_json",
            F.when(
                (F.size("_wrapper") == 2) & F.map_contains_key("_wrapper", F.md5("payload_text")),
                F.try_element_at("_wrapper", F.lit("v")),
            ),
        )
        .withColumns(
            {
                "_envelope": F.try_variant_get("_json", "$", "map<string,variant>"),
                "_payload": F.try_variant_get("_json", "$.payload", "map<string,variant>"),
            }
        )
        .withColumns(
            {
                # A JSON null decodes to nothing and is kept as text.
                "payload_is_json": F.coalesce(~F.is_variant_null("_json"), F.lit(False))
                & F.col("_json").isNotNull(),
                "_has_payload": F.coalesce(
                    F.map_contains_key("_envelope", F.lit("payload")), F.lit(False)
                ),
            }
        )
    )


def _event_type(family: Family) -> Column:
    field = _envelope_value("event_type")
    text = F.when(field.is_text, field.text)
    if family.default_type is None:
        return text
    return F.when(field.is_absent, F.lit(family.default_type)).otherwise(text)


@cache
def _typed_columns(family: Family, fields: Sequence[str]) -> dict[str, Column]:
    """Stored form of each field; the verdict decides whether a row may use them."""
    event_id, event_time = _envelope_value("event_id"), _envelope_value("event_time")
    typed = {
        "event_type": _event_type(family),
        "event_id": normalised_uuid(F.when(event_id.is_text, event_id.text)),
        "event_id_text": event_id.text,
        "event_time": aware_timestamp(F.when(event_time.is_text, event_time.text)),
        "source": _envelope_value("source").stripped,
    }
    for name in fields:
        field = _payload_value(name)
        if name == "amount":
            typed[name] = field.text.try_cast("decimal(38,2)").try_cast(MONEY)
            typed["_amount"] = field.number
        elif name in ("quantity", "status_code", "response_time_ms"):
            typed[f"_{name}"] = field.whole
            typed[name] = field.whole.try_cast("int")
        elif name in ("endpoint", "stack_trace"):
            typed[name] = field.text
        else:
            typed[name] = field.stripped
    return typed


@cache
def _broken_rules(family: Family) -> Column:
    version = _envelope_value("event_version")
    is_version_one = version.kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE)$") & (
        version.text.try_cast("double") == 1
    )
    supported = F.coalesce(F.col("event_type").isin(*family.event_types), F.lit(False))
    payload = F.lit(None).cast("string")
    for event_type in family.event_types:
        rules = PAYLOAD_RULES[event_type]
        messages = _joined(
            *[rule.message(f"payload.{name}", _payload_value(name)) for name, rule in rules.items()],
            _extra_fields("_payload", "p_", tuple(rules), "payload."),
        )
        payload = F.when(F.col("event_type") == event_type, messages).otherwise(payload)
    found = _joined(
        F.when(F.col("event_id").isNull(), F.lit("event_id: must be a UUID")),
        F.when(~supported, F.lit("event_type: must be a supported type")),
        F.when(
            ~version.is_absent & ~F.coalesce(is_version_one, F.lit(False)),
            F.lit("event_version: must be 1"),
        ),
        F.when(
            F.col("event_time").isNull(), F.lit("event_time: must be a timestamp with an offset")
        ),
        TEXT.message("source", _envelope_value("source")),
        F.when(F.col("_payload").isNull(), F.lit("payload: must be an object")),
        _extra_fields("_envelope", "e_", ENVELOPE_FIELDS, ""),
        F.when(F.col("_payload").isNotNull(), payload),
    )
    return F.when(F.col("_envelope").isNull(), F.lit("record: must be an object")).otherwise(found)


def _joined(*messages: Column) -> Column:
    """Messages that are set, separated; NULL when there is none."""
    return F.nullif(F.concat_ws("; ", *messages), F.lit(""))


def _extra_fields(map_column: str, prefix: str, allowed: Sequence[str], location: str) -> Column:
    """Message naming the unknown keys; they are listed only if the key counts differ."""
    present = F.lit(0)
    for name in allowed:
        is_set = F.col("_has_payload") if name == "payload" else F.col(f"_kind_{prefix}{name}").isNotNull()
        present = present + is_set.cast("int")
    unknown = F.array_except(
        F.map_keys(map_column), F.array(*[F.lit(name) for name in allowed])
    )
    problem = ": unknown field"
    listed = F.array_join(F.sort_array(unknown), f"{problem}; {location}")
    named = F.concat(F.lit(location), listed, F.lit(problem))
    return F.when(F.size(map_column) > present, named)


@cache
def _storage_violations(fields: Sequence[str]) -> Column:
    checks = [
        F.when(F.length(name) > width, F.lit(f"{name}: longer than {width} characters"))
        for name, width in TEXT_WIDTHS.items()
        if name in fields
    ]
    checks.append(
        F.when(F.length("topic") > TOPIC_WIDTH, F.lit("topic: longer than 255 characters"))
    )
    if "amount" in fields:
        beyond = (F.col("_amount") >= float(_MONEY_LIMIT)) | (
            F.col("_amount").isNotNull() & F.col("amount").isNull()
        )
        checks.append(F.when(beyond, F.lit("amount: beyond numeric(18,2)")))
    for name in ("quantity", "response_time_ms"):
        if name in fields:
            checks.append(
                F.when(F.col(f"_{name}") >= _INT_LIMIT, F.lit(f"{name}: beyond integer"))
            )
    return _joined(*checks)


@cache
def _verdict(family: Family) -> dict[str, Column]:
    bad_utf8 = ~F.col("_utf8")
    bad_json = F.col("_json").isNull()
    broken = F.col("_broken").isNotNull()
    too_wide = F.col("_too_wide").isNotNull()
    error_type = F.when(bad_utf8 | bad_json, F.lit("JSONDecodeError"))
    message = F.when(bad_utf8, F.lit("payload is not valid UTF-8")).when(
        bad_json, F.lit("payload is not valid JSON")
    )
    if family.reject_other_types_as:
        given = _envelope_value("event_type")
        other = ~given.is_absent_or_null & ~F.coalesce(
            F.col("event_type").isin(*family.event_types), F.lit(False)
        )
        error_type = error_type.when(other, F.lit(family.reject_other_types_as))
        message = message.when(
            other,
            F.lit("event_type: not accepted by this consumer"),
        )
    error_type = error_type.when(broken, F.lit("ValidationError")).when(
        too_wide, F.lit("StorageConstraintError")
    )
    message = message.when(broken, F.col("_broken")).when(
        too_wide, F.col("_too_wide")
    )
    return {
        "error_type": error_type,
        "error_message": message,
    }


# --- quarantine -------------------------------------------------------------------------


def dead_letters(rejected: DataFrame, consumer_group: str, failed_at: Column) -> DataFrame:
    """Dead-letter rows of decoded records whose ``error_type`` is set."""
    key = F.coalesce("key", F.lit(b""))
    key_text = key.cast("string")
    body = F.coalesce("value", F.lit(b""))
    encoding = (
        F.when(F.col("payload_is_json"), F.lit("json"))
        .when(F.col("payload_text").isNotNull(), F.lit("utf-8"))
        .otherwise(F.lit("base64"))
    )
    coordinate = F.concat_ws(
        ":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")
    )
    return rejected.select(
        F.coalesce(lenient_uuid(F.col("event_id_text")), coordinate).alias("dlq_key"),
        failed_at.alias("failed_at"),
        "error_type",
        "error_message",
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.lit(consumer_group).alias("consumer_group"),
        F.when(F.is_valid_utf8(key_text), key_text)
        .otherwise(F.base64(key))
        .alias("original_key"),
        F.coalesce("payload_text", F.base64(body)).alias("original_payload"),
        encoding.alias("original_payload_encoding"),
    )
