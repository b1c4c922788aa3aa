"""Epoch-second arithmetic and local calendars as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "America/Sao_Paulo"


def epoch_from_raw(raw: Column) -> Column:
    """Raw archive timestamps: microseconds from 10^15 up, milliseconds below."""
    return F.when(raw >= F.lit(10**15), F.floor(raw / F.lit(10**6))).otherwise(
        F.floor(raw / F.lit(10**3))).cast("bigint")


def grid_offset(ts: Column, step: int = 60) -> Column:
    """Distance of a timestamp to the nearest grid point."""
    rest = F.pmod(ts, F.lit(step))
    return F.least(rest, F.lit(step) - rest)


def realign(ts: Column, step: int = 60, max_offset: int = 30) -> Column:
    """Move an off-grid timestamp up to the next grid point; null when too far off."""
    rest = F.pmod(ts, F.lit(step))
    return (F.when(rest == 0, ts)
            .when(grid_offset(ts, step) <= F.lit(max_offset), ts + F.lit(step) - rest))


def floor_to(ts: Column, step: int) -> Column:
    return ts - F.pmod(ts, F.lit(step))


def day_index(ts: Column) -> Column:
    return F.floor(ts / F.lit(86400)).cast("bigint")


def month_start(ts: Column) -> Column:
    return F.unix_timestamp(F.date_trunc("month", F.timestamp_seconds(ts))).cast("bigint")


def month_end(ts: Column, step: int = 60) -> Column:
    nxt = F.add_months(F.to_date(F.date_trunc("month", F.timestamp_seconds(ts))), 1)
    return (F.unix_timestamp(nxt.cast("timestamp")) - F.lit(step)).cast("bigint")


def windows_between(start: Column, end: Column, days: int, step: int = 60) -> Column:
    """Consecutive closed windows of ``days`` days covering [start, end]."""
    first, last = floor_to(start, step), floor_to(end, step)
    span = days * 86400
    return F.transform(
        F.sequence(first, last, F.lit(span).cast("bigint")),
        lambda s: F.struct(s.alias("start_ts"), F.least(s + F.lit(span - step), last).alias("end_ts")))


def local_day_start(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Epoch seconds of local midnight."""
    local = F.from_utc_timestamp(F.timestamp_seconds(ts), zone)
    return F.unix_timestamp(F.to_utc_timestamp(F.date_trunc("day", local), zone)).cast("bigint")


def parse_local(text: Column, zone: str = DEFAULT_ZONE, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(text, pattern), zone)).cast("bigint")


def format_local(ts: Column, zone: str = DEFAULT_ZONE, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(ts), zone), pattern)


def calendar(ts: Column) -> dict[str, Column]:
    """Cyclic time-of-day and weekday features (the epoch began on a Thursday)."""
    turn = F.lit(2.0) * F.pi()
    seconds = F.pmod(ts, F.lit(86400)) * turn / F.lit(86400.0)
    weekday = F.pmod(day_index(ts) + F.lit(3), F.lit(7)) * turn / F.lit(7.0)
    return {
        "utc_time_sin": F.sin(seconds), "utc_time_cos": F.cos(seconds),
        "utc_weekday_sin": F.sin(weekday), "utc_weekday_cos": F.cos(weekday),
    }
