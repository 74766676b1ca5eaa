"""Masking of credentials in text, map and JSON-like columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The mask and the three patterns it applies to.
MASK = "[REDACTED]"
SECRET_KEY_PATTERN = "(?iU)(token|password|secret|private[_-]?key|authorization|credential)"
CONNECTION_PATTERN = "(?iU)(postgres(?:ql)?|https?)://[^\\s\"']+"
BEARER_PATTERN = "(?iU)bearer\\s+[a-z0-9._~+/-]+"


def scrub_text(text: Column | str) -> Column:
    """Mask connection URLs first, then bearer tokens, anywhere in the text."""
    column = F.col(text) if isinstance(text, str) else text
    without_urls = F.regexp_replace(column, CONNECTION_PATTERN, MASK)
    return F.regexp_replace(without_urls, BEARER_PATTERN, MASK)


def scrub_map(values: Column | str) -> Column:
    """Mask the value of every secret-like key; scrub the text of all other values."""
    column = F.col(values) if isinstance(values, str) else values
    return F.transform_values(
        column,
        lambda key, value: F.when(key.rlike(SECRET_KEY_PATTERN), F.lit(MASK)).otherwise(
            scrub_text(value)
        ),
    )


def scrub_array(values: Column | str) -> Column:
    """Scrub every element of a text array."""
    column = F.col(values) if isinstance(values, str) else values
    return F.transform(column, scrub_text)


def scrub_value(column: Column, kind: T.DataType) -> Column:
    """Scrub a value of any nesting: texts are masked in place, secret-like names hide what they hold.

    Names are struct fields and map keys. A hidden text becomes the mask; a hidden value of another
    kind becomes NULL, since the mask is no value of it.
    """
    if isinstance(kind, T.StringType):
        return scrub_text(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: scrub_value(item, kind.elementType))
    if isinstance(kind, T.MapType):
        hidden = _hidden(kind.valueType)
        return F.transform_values(
            column,
            lambda key, value: F.when(key.cast("string").rlike(SECRET_KEY_PATTERN), hidden).otherwise(
                scrub_value(value, kind.valueType)
            ),
        )
    if isinstance(kind, T.StructType):
        fields = [
            F.when(F.lit(field.name).rlike(SECRET_KEY_PATTERN), _hidden(field.dataType))
            .otherwise(scrub_value(column[field.name], field.dataType))
            .alias(field.name)
            for field in kind.fields
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def _hidden(kind: T.DataType) -> Column:
    return F.lit(MASK if isinstance(kind, T.StringType) else None).cast(kind)


def scrub_frame(frame: DataFrame) -> DataFrame:
    """Scrub every column of a table through all its levels; column names count as names."""
    whole = scrub_value(F.struct(*[F.col(f"`{name}`") for name in frame.columns]), frame.schema)
    return frame.select(whole.alias("_row")).select("_row.*")


# A quoted JSON name that is secret-like, with the text or plain value it holds.
_JSON_SECRET = (
    '(?iU)("[^"]*(?:token|password|secret|private[_-]?key|authorization|credential)[^"]*"\\s*:\\s*)'
    '(?:"(?:[^"\\\\]|\\\\.)*"|[^\\s,"{}\\[\\]]+)'
)


def scrub_json_text(text: Column | str) -> Column:
    """Mask secret-like members inside JSON text, then URLs and bearer tokens anywhere in it."""
    column = F.col(text) if isinstance(text, str) else text
    return scrub_text(F.regexp_replace(column, _JSON_SECRET, f'$1"{MASK}"'))
