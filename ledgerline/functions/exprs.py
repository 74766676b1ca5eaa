"""Scalar expressions shared by the models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CountLike = Column | str


def _col(value: CountLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_divide(numerator: CountLike, denominator: CountLike) -> Column:
    """Exact ratio of two whole numbers; NULL when the denominator is NULL or zero."""
    top = _col(numerator).cast("decimal(20,0)")
    bottom = _col(denominator).cast("decimal(20,0)")
    return F.try_divide(top, bottom)


def utc_date(timestamp: CountLike) -> Column:
    """Calendar date of a timestamp (the session time zone is UTC)."""
    return F.to_date(_col(timestamp))


def utc_minute(timestamp: CountLike) -> Column:
    """Start of the tumbling one-minute window a timestamp falls into."""
    return F.date_trunc("minute", _col(timestamp))


def seconds_between(later: CountLike, earlier: CountLike) -> Column:
    """Signed difference in seconds, exact to the microsecond."""
    micros = F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))
    return (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast(
        "decimal(20,6)"
    )


def status_flags(status: CountLike) -> dict[str, Column]:
    """0/1 contributions of one HTTP status code to the three outcome counters."""
    code = _col(status)
    return {
        "success_count": code.between(100, 399).cast("int"),
        "client_error_count": code.between(400, 499).cast("int"),
        "server_error_count": code.between(500, 599).cast("int"),
    }


def is_stale(last_seen: CountLike, as_of: Column) -> Column:
    """True when a timestamp is more than 24 hours old; NULL when it is unknown."""
    return as_of - F.expr("INTERVAL 24 HOURS") > _col(last_seen)


def floored_rate(count: CountLike, elapsed_seconds: CountLike) -> Column:
    """Events per second with the elapsed time floored at one nanosecond."""
    elapsed = F.greatest(_col(elapsed_seconds).cast("double"), F.lit(1e-9))
    return _col(count).cast("double") / elapsed
