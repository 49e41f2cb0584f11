"""Sessions by time gap, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthbook.functions.dates import fmt_duration
from hearthbook.operators.ordering import KEY, earlier_slices, inside_slice, keyed, number_rows, whole_group


def seconds_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def sessionize(
    df: DataFrame, ts: str, gap_seconds: int = 7200, keys: Sequence[str] = (), slice_by: Column | None = None
) -> DataFrame:
    """Add ``session_start``: a session ends where the next row is more than the gap away.

    Works per day, so one busy key or an input without keys still spreads over all tasks.
    """
    sliced = keyed(df, list(keys), slice_by if slice_by is not None else F.to_date(F.col(ts)))
    over_slices = whole_group(keys).orderBy(f"{KEY}.s")
    ends = sliced.groupBy(KEY).agg(F.max(ts).alias("_max"))
    ends = ends.select(KEY, F.lag("_max").over(over_slices).alias("_prev_end"))

    inside = inside_slice([F.col(ts)])
    prev = F.coalesce(F.lag(ts).over(inside), F.col("_prev_end"))
    passed = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    starts = prev.isNull() | (passed > gap_seconds * 1_000_000)
    marked = sliced.join(ends, KEY).withColumn("_start", F.when(starts, F.col(ts)))

    open_at_end = marked.groupBy(KEY).agg(F.max("_start").alias("_last_start"))
    carried = open_at_end.select(KEY, F.last("_last_start", ignorenulls=True).over(earlier_slices(keys)).alias("_carried"))
    so_far = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(F.max("_start").over(so_far), F.col("_carried"))
    return marked.join(carried, KEY).withColumn("session_start", start).drop("_prev_end", "_start", "_carried", KEY)


def event_summary(
    sessions: DataFrame, ts: str, keys: Sequence[str] = (), min_rows: int = 3,
    is_photo: Column | None = None, is_video: Column | None = None,
    lat: str | None = None, lon: str | None = None,
) -> DataFrame:
    """One row per session with at least ``min_rows`` rows."""
    zero = F.lit(0)
    aggs = [
        F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("members"),
        F.sum(F.when(is_photo, 1).otherwise(0) if is_photo is not None else zero).alias("photos"),
        F.sum(F.when(is_video, 1).otherwise(0) if is_video is not None else zero).alias("videos"),
    ]
    if lat and lon:
        aggs += [F.avg(lat).alias("mean_lat"), F.avg(lon).alias("mean_lon")]
    out = sessions.groupBy(*keys, "session_start").agg(*aggs).filter(F.col("members") >= min_rows)
    length = seconds_of(F.col("session_end")) - seconds_of(F.col("session_start"))
    return out.withColumn("duration", fmt_duration(length))


def number_events(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running number of the kept sessions, by start."""
    return number_rows(events, keys, [F.asc("session_start")], F.to_date("session_start"), "event_no")


def event_folder(event_no: Column, start: Column, end: Column) -> Column:
    """Folder name of an event; the length is shown when it is over an hour."""
    length = seconds_of(end) - seconds_of(start)
    long = F.concat(F.lit("__"), F.replace(fmt_duration(length), F.lit(" "), F.lit("")))
    return F.concat(
        F.lit("Event_"), F.lpad(event_no.cast("string"), F.greatest(F.lit(3), F.length(event_no.cast("string"))), F.lit("0")), F.lit("__"),
        F.date_format(start, "yyyy-MM-dd_HHmm"), F.when(length > 3600, long).otherwise(""),
    )


def largest_events(events: DataFrame, k: int = 10) -> DataFrame:
    return events.orderBy(F.desc("members"), F.asc("session_start")).limit(k)
