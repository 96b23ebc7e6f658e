"""Timestamp coercion. Text without a zone is read as UTC, whatever the session zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarloom.functions.text import clean

ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,6})?)?(Z|z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"
)
MAIL = (
    r"^(?:[A-Za-z]{3,9},\s*)?(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -](\d{4})\s+"
    r"(\d{1,2}:\d{2})(:\d{2})?(?:\s+([+-]\d{4}|[A-Za-z]{1,4}))?(?:\s*\(.*\))?$"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MAIL_ZONES = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
              "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
MS_LIMIT = 10_000_000_000


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _zone(zone: Column) -> Column:
    """``Z`` or an offset as ``+hh:mm``."""
    digits = F.regexp_replace(zone, ":", "")
    offset = F.concat(F.substring(digits, 1, 3), F.lit(":"), F.substring(digits, 4, 2))
    return F.when(zone.rlike(r"^[+-]\d"), offset).otherwise(F.lit("Z"))


def iso_timestamp(text: Column, *, strict: bool = False) -> Column:
    """ISO text to timestamp; ``strict`` turns text without a zone into NULL."""
    value = F.trim(text)
    zone = _part(value, ISO, 4)
    stamp = F.concat(
        _part(value, ISO, 1), F.lit("T"), F.coalesce(_part(value, ISO, 2), F.lit("00:00")),
        F.coalesce(_part(value, ISO, 3), F.lit(":00")), F.coalesce(_zone(zone), F.lit("Z")),
    ).try_cast("timestamp")
    return F.when(zone.isNotNull(), stamp) if strict else stamp


def mail_timestamp(text: Column) -> Column:
    """RFC 2822 date, as feeds use it."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(_part(text, MAIL, 2)))
    named = F.upper(_part(text, MAIL, 6))
    zones = F.create_map(*[F.lit(x) for pair in MAIL_ZONES.items() for x in pair])
    zone = F.coalesce(zones[named], _zone(_part(text, MAIL, 6)), F.lit("Z"))
    return F.concat(
        _part(text, MAIL, 3), F.lit("-"), F.lpad(F.nullif(month, F.lit(0)).cast("string"), 2, "0"), F.lit("-"),
        F.lpad(_part(text, MAIL, 1), 2, "0"), F.lit("T"), F.lpad(_part(text, MAIL, 4), 5, "0"),
        F.coalesce(_part(text, MAIL, 5), F.lit(":00")), zone,
    ).try_cast("timestamp")


def epoch_timestamp(number: Column) -> Column:
    """Seconds, or milliseconds when the number is too large for seconds."""
    seconds = F.when(number > MS_LIMIT, number / 1000).otherwise(number)
    in_range = seconds.between(-62_135_596_800, 253_402_300_799)
    return F.when(in_range, F.timestamp_micros((seconds * 1_000_000).cast("bigint")))


def any_timestamp(text: Column, number: Column | None = None) -> Column:
    """ISO, then mail form; a JSON number when one is given; NULL when nothing fits."""
    # The one-element array evaluates the cleaned text once, for all the patterns that look at it.
    once = F.transform(F.array(clean(text)), lambda v: F.coalesce(iso_timestamp(v), mail_timestamp(v)))
    parsed = once[0]
    return parsed if number is None else F.coalesce(epoch_timestamp(number), parsed)
