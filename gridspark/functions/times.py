"""Time axes: year-day integers, relative numbers and their calendars."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_US = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def parse_reference(text: str) -> tuple[str, datetime]:
    """``unit since date``: the unit without plural, and the date in UTC; time, zone and parts of them may lack."""
    unit, _, date = text.strip().partition(" since ")
    unit = {"hr": "hour", "h": "hour", "min": "minute", "sec": "second", "s": "second", "d": "day"}.get(unit.strip().rstrip("s") or "s", unit.strip().rstrip("s"))
    m = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d+))?)?)?)?\s*(UTC|Z|[+-]\d{1,2}:?\d{0,2})?", date.strip())
    if not m or unit not in UNIT_US:
        raise ValueError(f"not a time reference: {text}")
    y, mo, d, h, mi, s, frac, zone = m.groups()
    at = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int(((frac or "0") + "000000")[:6]), tzinfo=UTC)
    if zone and zone not in ("UTC", "Z"):
        digits = zone[1:].replace(":", "").ljust(4, "0") if len(zone) > 3 else zone[1:].zfill(2) + "00"
        off = timedelta(hours=int(digits[:2]), minutes=int(digits[2:4]))
        at -= off if zone[0] == "+" else -off
    return unit, at


def from_number(c: Column, reference: str) -> Column:
    """Timestamps of relative numbers."""
    unit, at = parse_reference(reference)
    return F.timestamp_micros(F.round(c.cast("double") * UNIT_US[unit]).cast("long") + int((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)))


def to_number(ts: Column, reference: str) -> Column:
    unit, at = parse_reference(reference)
    return (F.unix_micros(ts.cast("timestamp")) - int((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))) / UNIT_US[unit]


def noleap_date(days: Column, year: int) -> tuple[Column, Column]:
    """Year and day of the year (from 1) of days since the start of a year, all years having 365 days."""
    return (year + F.floor(days / 365)).cast("int"), (F.pmod(F.floor(days), F.lit(365)) + 1).cast("int")


def yyyyjjj(ts: Column) -> Column:
    return F.date_format(ts, "yyyyDDD").cast("int")


def hhmmss(ts: Column) -> Column:
    return F.date_format(ts, "HHmmss").cast("int")


def from_yyyyjjj(date: Column, time: Column) -> Column:
    """Timestamps of year-day and hour-minute-second integers."""
    return F.to_timestamp(F.concat(F.lpad(date.cast("string"), 7, "0"), F.lpad(time.cast("string"), 6, "0")), "yyyyDDDHHmmss")


def widen_year(date: Column) -> Column:
    """Two-digit years before their day: below 70 in this century."""
    return F.when(date < 70_000, date + 2_000_000).when(date < 100_000, date + 1_900_000).otherwise(date).cast("int")


def add_hours(date: int, hhmm: float, hours: float) -> tuple[int, float]:
    """A year-day and hour-minute pair, some hours on."""
    at = datetime.strptime(f"{int(date):07d}", "%Y%j") + timedelta(hours=int(hhmm // 100), minutes=hhmm % 100) + timedelta(hours=hours)
    return int(at.strftime("%Y%j")), at.hour * 100.0 + at.minute


def hours_between(a: tuple[int, float], b: tuple[int, float]) -> float:
    at = lambda x: datetime.strptime(f"{int(x[0]):07d}", "%Y%j") + timedelta(hours=int(x[1] // 100), minutes=x[1] % 100)
    return (at(b) - at(a)) / timedelta(hours=1)


def hour_bin(ts: Column) -> Column:
    """The hour that ends at or after a time: bins open at their start."""
    return F.date_trunc("hour", F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) - 1))


def from_pieces(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Timestamps of date pieces; years of two digits are 1969 to 2068; impossible dates are NULL."""
    y = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.try_make_timestamp(y, month, day, hour, minute, F.lit(0).cast("decimal(8,6)"))
