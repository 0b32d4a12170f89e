"""Instants on the wire (RFC 3339, UTC, milliseconds), cron slots and day labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIRE = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
WIRE_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def instant(ts: Column) -> Column:
    """A timestamp without zone as an instant in UTC."""
    return ts.cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(instant(ts))


def wire(ts: Column) -> Column:
    """Floored to milliseconds."""
    return F.date_format(instant(ts), WIRE)


def strict(value: Column) -> Column:
    """The instant of a wire string; null unless it reads back as itself."""
    at = F.try_to_timestamp(value, F.lit(WIRE))
    return F.when(value.rlike(WIRE_SHAPE) & (F.date_format(at, WIRE) == value), at)


def lenient(value: Column) -> Column:
    """The instant of any RFC 3339 string, null if it is none."""
    return F.try_to_timestamp(value)


def cron_slot(ts: Column, every: int = 5, offset: int = 2) -> Column:
    """Start of the slot that holds an instant: slots start offset minutes past each multiple of every."""
    span, start = every * 60_000_000, offset * 60_000_000
    us = micros(ts)
    return us - F.pmod(us - start, F.lit(span))


def window_seconds(first: Column, last: Column) -> Column:
    """Whole seconds between two instants in microseconds, each floored to a millisecond."""
    return F.floor((F.floor(last / 1000) - F.floor(first / 1000)) / 1000).cast("long")


def rotation_offset(us: Column, n: Column) -> Column:
    """Where a fair rotation of n groups starts in the five-minute slot of an instant."""
    at = F.timestamp_micros(us)
    minutes = F.hour(at) * 60 + F.minute(at)
    return F.when(n > 0, F.pmod(F.dayofyear(at) * 288 + F.floor(minutes / 5), n)).otherwise(0).cast("int")


def rotated(groups: Column, offset: Column) -> Column:
    n = F.greatest(F.size(groups), F.lit(1))
    k = F.pmod(offset, n)
    return F.concat(F.slice(groups, k + 1, n), F.slice(groups, F.lit(1), k))
