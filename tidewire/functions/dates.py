"""Date expressions. The session time zone must be UTC (``tidewire.session.tune``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted besides ISO 8601; anything else counts as unparseable.
DATE_FORMATS = (
    "yyyyMMdd'T'HHmmssX",
    "yyyyMMdd'T'HHmmss",
    "yyyyMMddHHmmss",
    "yyyyMMdd",
    "yyyy/M/d",
    "yyyy-M-d",
    "d MMM yyyy HH:mm:ss Z",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
)
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"
_WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), "
_ZONE = r" (?:GMT|UTC|UT|Z)$"


def parse_timestamp(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Instant named by ``c``, read as UTC unless it carries an offset; NULL if none fits."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), _WEEKDAY, ""), _ZONE, " +0000")
    tries = [F.when(text.rlike(_ISO), text.try_cast("timestamp"))]
    tries += [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def iso_utc(ts: Column) -> Column:
    """``2024-08-05T10:00:00+00:00``, with microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def normalize_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return iso_utc(parse_timestamp(c, formats))


def gkg_date(c: Column) -> Column:
    """First eight characters as a day, printed as midnight UTC."""
    day = F.try_to_timestamp(F.substring(c.cast("string"), 1, 8), F.lit("yyyyMMdd"))
    return F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def floor_quarter(ts: Column) -> Column:
    """Start of the quarter of an hour that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 900) * 900)


def slot_name(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")
