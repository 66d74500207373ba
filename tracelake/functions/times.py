"""Time functions: strict parsing, whole microseconds, bins, deadlines and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds until an alert of each severity is due.
DUE_SECONDS = {"critical": 900, "high": 3600, "medium": 14400, "low": 86400}


def utc_timestamp(text: Column) -> Column:
    """A timestamp from ISO-8601 text with an explicit zone; null without one. Digits beyond microseconds are dropped."""
    return F.when(text.rlike(r"([Zz]|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def micros(ts: Column) -> Column:
    """Whole microseconds since 1970, for timestamps with and without zone (session zone UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def nanos(seconds: Column, fraction: Column, fraction_digits: int) -> Column:
    """Whole nanoseconds from seconds and a fraction of so many digits."""
    return seconds.cast("long") * 1_000_000_000 + fraction.cast("long") * 10 ** (9 - fraction_digits)


def nanos_text(ns: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(F.expr("0")) + F.make_dt_interval(secs=F.floor(ns / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.pmod(ns, F.lit(1_000_000_000))).cast("string"), 9, "0"), F.lit("Z"))


def bin_start(ts: Column, seconds: int) -> Column:
    """The start of the tumbling bin that holds ts, counted from 1970."""
    m = micros(ts)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.floor(m / (seconds * 1_000_000)) * seconds).cast("decimal(18,6)"))


def due(created: Column, severity: Column, seconds: dict[str, int] = DUE_SECONDS) -> Column:
    wait = F.coalesce(*[F.when(severity == k, F.lit(v)) for k, v in seconds.items()])
    return created + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next attempt: 2 to the attempts made, at most 300."""
    return F.least(F.lit(300), F.pow(F.lit(2), F.least(attempt + 1, F.lit(8))).cast("long")).cast("long")
