"""Column functions for dates, eras and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthbook.functions.text import extract
from hearthbook.rulesets import timeline

# Date layouts seen on articles, tried in this order.
ARTICLE_DATES = [
    "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy", "MMMM yyyy", "MMM yyyy",
]


def parse_when(c: Column, formats: list[str] = ARTICLE_DATES) -> Column:
    """First layout that reads the text, as a timestamp without zone."""
    return F.coalesce(
        *[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("timestamp_ntz") for f in formats]
    )


def mail_date(c: Column) -> Column:
    """Wall-clock time of a mail Date header; weekday and zone are dropped."""
    wall = extract(c, r"(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?)")
    return F.coalesce(
        F.try_to_timestamp(wall, F.lit("d MMM yyyy H:mm:ss")),
        F.try_to_timestamp(wall, F.lit("d MMM yyyy H:mm")),
    ).cast("timestamp_ntz")


def article_date(c: Column) -> Column:
    """ISO day when a layout fits, else the text as it was."""
    return F.coalesce(F.date_format(parse_when(c), "yyyy-MM-dd"), c)


def epoch_day(seconds: Column) -> Column:
    """ISO day (UTC) of an epoch; ``Unknown`` when missing."""
    return F.coalesce(
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit("Unknown")
    )


def gap_days(last: Column, as_of: str) -> Column:
    """Whole days from the last contact to ``as_of``."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    return F.floor(seconds / 86400).cast("int")


def era_tag(year: Column, ranges=timeline.PRESS_ERAS) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, lo, hi in ranges:
        out = out.when(year.between(lo, hi), name)
    return out.otherwise("unknown-era")


def eras(first: Column, last: Column, table=timeline.CONTACT_ERAS) -> Column:
    """Every era a contact was active in, oldest first; ``unknown`` without a first date."""
    y1, y2 = F.year(first), F.year(F.coalesce(last, first))
    found = []
    for name, lo, hi in table:
        if lo is None:
            inside = y1 <= hi
        elif hi is None:
            inside = y2 >= lo
        else:
            inside = (y1 <= hi) & (y2 >= lo)
        found.append(F.when(inside, F.lit(name)))
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    unknown = F.array(F.lit("unknown"))
    return F.when(first.isNull() | (F.size(listed) == 0), unknown).otherwise(listed)


def fmt_duration(seconds: Column) -> Column:
    """``3h 5m`` or ``5m``."""
    whole = F.floor(seconds)
    hours = F.floor(whole / 3600).cast("bigint")
    minutes = F.floor((whole % 3600) / 60).cast("bigint")
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(
        F.format_string("%dm", minutes)
    )


def period_key(ts: Column, unit: str = "month") -> Column:
    layout = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    return F.coalesce(F.date_format(ts, layout), F.lit("unknown"))


def file_date(name: Column, mod_time: Column) -> Column:
    """Date in a file name (day, else month), else the file time."""
    day = r"(20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])"
    month = r"(20\d{2})[-_.](0[1-9]|1[0-2])"

    def part(p: str, i: int) -> Column:
        return F.regexp_extract(name, p, i)

    full = F.concat_ws("-", part(day, 1), part(day, 2), part(day, 3))
    first = F.concat_ws("-", part(month, 1), part(month, 2), F.lit("01"))
    return F.coalesce(
        F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date"),
        F.try_to_timestamp(first, F.lit("yyyy-MM-dd")).cast("date"),
        mod_time.cast("date"),
    )


def add_date_prefix(name: Column, day: Column) -> Column:
    """``2025-07-15_name``; names that carry a prefix stay."""
    return F.when(has_date_prefix(name), name).otherwise(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), name)
    )


def drop_date_prefix(name: Column) -> Column:
    return F.when(has_date_prefix(name), F.substr(name, F.lit(12))).otherwise(name)


def has_date_prefix(name: Column) -> Column:
    return (
        (F.length(name) > 11)
        & (F.substring(name, 5, 1) == "-")
        & (F.substring(name, 8, 1) == "-")
        & (F.substring(name, 11, 1) == "_")
    )
