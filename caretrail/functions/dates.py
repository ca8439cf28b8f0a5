"""Dates as the web client reads and writes them. Stored moments are TIMESTAMP_NTZ holding UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caretrail.functions.defaults import col

BARE_DATE = r"^\d{4}-\d{2}-\d{2}$"
MOMENT = (
    r"^\d{4}-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01])"
    r"(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?)?$"
)
EPOCH = "1970-01-01 00:00:00"

# En-US date patterns of the pages.
STYLES = {"long": "MMM d, yyyy", "short": "MMM d", "input": "yyyy-MM-dd", "utc": "yyyy-MM-dd"}


def _day(year: Column, month: Column, day: Column) -> Column:
    """Calendar day from its numbers; a month or day beyond its range rolls over."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1).cast("timestamp_ntz")


def _to_utc(local: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def _piece(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def _instant(text: Column) -> Column:
    """UTC moment, to the millisecond, of text that ends in Z or an offset. Counted from 1970, so that the session's
    zone does not come into it."""
    millis = F.unix_millis(text.try_cast("timestamp"))
    return F.timestamp_add("MILLISECOND", millis, F.lit(EPOCH).cast("timestamp_ntz"))


def parse_instant(c: Column | str, tz: str = "UTC") -> Column:
    """ISO text to UTC. A bare date is UTC midnight, a time without offset is in ``tz``; other text gives null."""
    text = col(c)
    tail = F.substring(text, 11, 40)
    zoned = tail.rlike("[Z+-]")
    # Spark's own parser takes it from here; it wants a day, seconds and a zone
    timed = F.when(F.substring(text, 17, 1) == ":", text).otherwise(
        F.concat(F.substring(text, 1, 16), F.lit(":00"), F.substring(text, 17, 40))
    )
    full = (
        F.when(F.length(text) == 7, F.concat(text, F.lit("-01T00:00:00Z")))
        .when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z")))
        .when(zoned, timed)
        .otherwise(F.concat(timed, F.lit("Z")))
    )
    # a day beyond its month: as many days after the first
    first = F.concat(F.substring(full, 1, 8), F.lit("01"), F.substring(full, 11, 40))
    days = F.make_dt_interval(_piece(full, 9, 2) - 1)
    moment = F.coalesce(_instant(full), _instant(first) + days)
    if tz != "UTC":
        moment = F.when((F.length(text) > 10) & ~zoned, _to_utc(moment, tz)).otherwise(moment)
    return F.when(text.rlike(MOMENT), moment)


def parse_local_date(c: Column | str, tz: str = "UTC") -> Column:
    """``YYYY-MM-DD`` to noon of that day in ``tz`` (as UTC); other text as an instant."""
    text = col(c)
    year = _piece(text, 1, 4)
    century = F.when(year < 100, year + 1900).otherwise(year)
    noon = _day(century, _piece(text, 6, 2), _piece(text, 9, 2)) + F.expr("INTERVAL '12' HOUR")
    return F.when(text.rlike(BARE_DATE), _to_utc(noon, tz)).otherwise(parse_instant(text, tz))


def format_date(c: Column | str, style: str = "long", tz: str = "UTC", empty: str = "") -> Column:
    """A stored moment as date text: ``long``, ``short``, ``input`` in ``tz``, or ``utc``; ``empty`` for null."""
    moment = col(c)
    local = moment if style == "utc" else F.convert_timezone(F.lit("UTC"), F.lit(tz), moment)
    return F.coalesce(F.date_format(local.cast("date"), STYLES[style]), F.lit(empty))
