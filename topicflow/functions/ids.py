"""Identifiers and timestamps of incoming messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated a single time, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def external_id(given: Column, title: Column, source: Column, published_at: Column, text: Column) -> Column:
    """The given id, or SHA-256 over ``title|source|published_at|text``."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, source, published_at, text)]
    return F.coalesce(blank_to_null(given), F.sha2(F.concat_ws("|", *parts), 256))


def article_id(url: Column, title: Column, published_at: Column, text: Column) -> Column:
    """The article URL, or SHA-256 over title, date and text without separators."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, published_at, text)]
    return F.coalesce(blank_to_null(url), F.sha2(F.concat(*parts), 256))


def news_id(ext_id: Column) -> Column:
    """Deterministic row id, so that a replayed message keeps its id."""
    return F.sha2(ext_id, 256)


def report_id(news: Column) -> Column:
    return F.sha2(F.concat(F.lit("report|"), news), 256)


def truncate_error(message: Column, limit: int = 1000) -> Column:
    return F.substring(message, 1, limit)


# date forms: 2024, 2024-01, 2024-01-02, 20240102, 2024-W01, 2024-W01-2, 2024W01, 2024W012
_DATE = r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?|(\d{2})(\d{2})|-?W(\d{2})(?:-?([1-7]))?)?"
_TIME = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?"
ISO_8601 = rf"(?s)^{_DATE}(?:.{_TIME})?$"


def parse_iso8601(col: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, null when malformed or out of range.

    Accepts calendar (extended and basic) and week dates, an optional time after
    any one separator, fractions and UTC offsets. Text without an offset is read
    in the session time zone.
    """

    groups = "\x1f".join(f"${i}" for i in range(1, 13))
    parts = F.when(col.rlike(ISO_8601), F.split(F.regexp_replace(col, ISO_8601, groups), "\x1f"))
    return once(parts, _assemble)


def _assemble(parts: Column) -> Column:
    def part(i: int) -> Column:
        return F.nullif(F.get(parts, i - 1), F.lit(""))

    year = part(1).cast("int")
    month = F.coalesce(part(2), part(4), F.lit("1")).cast("int")
    day = F.coalesce(part(3), part(5), F.lit("1")).cast("int")
    week, weekday = part(6).cast("int"), F.coalesce(part(7), F.lit("1")).cast("int")
    hour = F.coalesce(part(8), F.lit("0")).cast("int")
    minute = F.coalesce(part(9), F.lit("0")).cast("int")
    second = F.concat(F.coalesce(part(10), F.lit("0")), F.lit("."), F.coalesce(part(11), F.lit("0")))
    midnight = (hour == 24) & (minute == 0) & (second.cast("double") == 0)
    zone = part(12)
    zone = F.when(zone == "Z", F.lit("+00:00")).otherwise(
        F.regexp_replace(F.rpad(F.regexp_replace(zone, ":", ""), 5, "0"), r"^(...)", "$1:")
    )
    # ISO week 1 holds January 4th
    first_monday = F.date_trunc("week", F.try_make_timestamp(year, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0)))
    week_day = F.date_add(first_monday.cast("date"), (week - 1) * 7 + weekday - 1)
    y = F.when(week.isNull(), year).otherwise(F.year(week_day))
    m = F.when(week.isNull(), month).otherwise(F.month(week_day))
    d = F.when(week.isNull(), day).otherwise(F.dayofmonth(week_day))
    h = F.when(midnight, F.lit(0)).otherwise(hour)
    sec = second.cast("decimal(8,6)")
    local = F.try_make_timestamp(y, m, d, h, minute, sec)
    zoned = F.try_make_timestamp(y, m, d, h, minute, sec, zone)
    ts = F.when(zone.isNull(), local).otherwise(zoned)
    ts = F.when(midnight, ts + F.expr("interval 1 day")).otherwise(ts)
    return F.when((week.isNull() | week.between(1, 53)) & (sec < 60), ts)
