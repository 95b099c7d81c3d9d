"""Scalar functions, all as Column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- time ----------------------------------------------------------------------------------------------------------------

def epoch_floor(ts: str | Column, seconds: int) -> Column:
    """Start of the fixed bucket since the epoch that ts is in."""
    return epoch_floor_micros(ts, seconds * 1_000_000)


def epoch_floor_micros(ts: str | Column, micros: int) -> Column:
    us = F.unix_micros(_c(ts))
    return F.timestamp_micros(us - F.pmod(us, F.lit(micros)))


#: Seconds of the fixed periods, by name.
FIXED_PERIODS = {"1s": 1, "5s": 5, "15s": 15, "30s": 30, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "12h": 43200}
CALENDAR_PERIODS = {"1d": "day", "1w": "week", "1mo": "month", "1q": "quarter", "1y": "year"}


def calendar_start(date: str | Column, period: str) -> Column:
    """First date of the day, Monday week, month, quarter or year that a date is in."""
    return F.to_date(F.date_trunc(CALENDAR_PERIODS[period], _c(date)))


def calendar_end(date: str | Column, period: str) -> Column:
    """First date after it."""
    start = calendar_start(date, period)
    if period in ("1d", "1w"):
        return F.date_add(start, 1 if period == "1d" else 7)
    return F.add_months(start, {"1mo": 1, "1q": 3, "1y": 12}[period])


def next_weekday(date: Column) -> Column:
    """The date itself, or the Monday after a weekend."""
    return F.date_add(date, F.when(F.weekday(date) == 5, 2).when(F.weekday(date) == 6, 1).otherwise(0))


def trading_date(rule: str, local_start: Column, local_end: Column) -> Column:
    """Trading date of a session: that of its end, of its start, or by the night rule: from 18:00 on the next weekday's."""
    if rule == "session_end":
        return F.to_date(local_end)
    if rule == "session_start":
        return F.to_date(local_start)
    if rule == "night":
        return F.when(F.hour(local_start) >= 18, next_weekday(F.date_add(F.to_date(local_start), 1))).otherwise(F.to_date(local_start))
    raise ValueError(f"unknown trading date rule {rule!r}")


def to_local(ts: str | Column, zone: str) -> Column:
    return F.from_utc_timestamp(_c(ts), zone)


def to_utc(local: str | Column, zone: str) -> Column:
    return F.to_utc_timestamp(_c(local), zone)


def bucket_start(ts: str | Column, period: str) -> Column:
    if period in FIXED_PERIODS:
        return epoch_floor(ts, FIXED_PERIODS[period])
    return calendar_start(F.to_date(_c(ts)), period).cast("timestamp")


def seconds_to_close(ts: str | Column, period: str) -> Column:
    """Seconds from ts to the end of its bucket."""
    if period in FIXED_PERIODS:
        end = F.unix_micros(epoch_floor(ts, FIXED_PERIODS[period])) / 1e6 + FIXED_PERIODS[period]
    else:
        end = F.unix_micros(calendar_end(F.to_date(_c(ts)), period).cast("timestamp")) / 1e6
    return end - F.unix_micros(_c(ts)) / 1e6


def available_at(interval_seconds: str | Column, bucket_end: str = "bucket_end", finalized: str = "finalized_at", opened: str = "open_time") -> Column:
    """When a bar can be known: its bucket's end, else when it was finalised, else open plus interval."""
    return F.coalesce(F.col(bucket_end), F.col(finalized), F.timestamp_micros(F.unix_micros(opened) + _c(interval_seconds).cast("long") * 1_000_000))


# --- numbers -------------------------------------------------------------------------------------------------------------

def decimal_scale(text: str | Column) -> Column:
    """Digits behind the point of a number's text, trailing zeros counted."""
    return F.length(F.regexp_extract(_c(text), r"\.(\d+)$", 1))


def on_lattice(value: str | Column, quantum: str | Column) -> Column:
    """Is the value, as an exact decimal, a multiple of quantum?"""
    return F.pmod(_c(value).cast("decimal(20,8)"), _c(quantum).cast("decimal(20,8)")) == 0


def time_aligned(ts: str | Column, micros: int) -> Column:
    return F.pmod(F.unix_micros(_c(ts)), F.lit(micros)) == 0


def deviation_bps(a: str | Column, b: str | Column) -> Column:
    """Absolute difference in basis points of the middle; null where that is zero."""
    return F.try_divide(F.abs(_c(a) - _c(b)) * 20_000.0, F.abs(_c(a) + _c(b)))


def ratio(a: str | Column, b: str | Column, digits: int = 4) -> Column:
    """a / b rounded half to even; null if b is zero."""
    return F.bround(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), digits)


def clamp_delta(delta: str | Column, tolerance: float = 1e-5) -> Column:
    """An option delta a little beyond one is one; further out it is null."""
    d = _c(delta)
    return F.when(F.abs(d) <= 1, d).when(F.abs(d) <= 1 + tolerance, F.signum(d))


def micros_to_price(value: str | Column) -> Column:
    return (_c(value).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bounded_score(z: str | Column) -> Column:
    """25 points for each robust deviation, 100 at most."""
    return F.least(F.lit(100.0), F.abs(_c(z)) * 25)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def positioning_state(ratio_: str | Column) -> Column:
    r = _c(ratio_)
    return F.when(r.isNull(), "unavailable").when(r >= 1.2, "put_heavy").when(r <= 0.8, "call_heavy").otherwise("balanced")


def change_rounded(last: str | Column, previous: str | Column) -> tuple[Column, Column]:
    """Change, and its percentage of previous rounded half to even to two digits."""
    change = _c(last) - _c(previous)
    return change, F.bround(F.try_divide(change, _c(previous)) * 100, 2)


def change_absolute(last: str | Column, previous: str | Column) -> tuple[Column, Column]:
    """Change, and its percentage of abs(previous); null without a previous value or where it's zero."""
    change = _c(last) - _c(previous)
    return change, F.try_divide(change, F.abs(_c(previous))) * 100


# --- identifiers and JSON ------------------------------------------------------------------------------------------------

def event_id(kind: Column, source: Column, channel: Column, instrument: Column, ts: Column, sequence: Column, revision: Column) -> Column:
    """Seven parts joined by colons, time in microseconds, absent parts as a dash."""
    parts = (kind, source, channel, instrument, F.date_format(ts, "yyyyMMdd'T'HHmmss.SSSSSS"), sequence.cast("string"), revision.cast("string"))
    return F.concat_ws(":", *(F.coalesce(p, F.lit("-")) for p in parts))


def schedule_version(schedule: dict) -> str:
    """sha256 of a schedule's canonical JSON: bars made under another schedule have another version."""
    return hashlib.sha256(json.dumps(schedule, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def evidence_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def evidence_field(payload: str | Column, path: str) -> Column:
    return F.get_json_object(_c(payload), f"$.{path}")
