"""Column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def leading_int(c: Column, digits: int = 6) -> Column:
    """The number of the first digits a text begins with, or null: '159-48' is 159, 'REAR' is null."""
    return F.regexp_extract(c, r"^\s*(\d{1,%d})" % digits, 1).try_cast("int")


def five_digits(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{5}$"), c)


def neutral_cell(c: Column) -> Column:
    """A text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def content_key(*columns: str, length: int = 16) -> Column:
    """The first hex digits of a SHA-256 over a row's canonical JSON; absent values are left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, length)


def days_to_mask(days: Column) -> Column:
    """Bit d for each day d (Monday 0) of an array."""
    return F.aggregate(days, F.lit(0), lambda a, d: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), d.cast("int"))))


def mask_to_days(mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: F.call_function("getbit", mask, d) == 1)


def has_day(mask: Column, day: Column) -> Column:
    return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), day)) != 0


def flag_bits(*flags: Column) -> Column:
    """Bit i set where flag i is true, in the order given."""
    total = F.lit(0)
    for i, f in enumerate(flags):
        total = total + F.when(f, F.lit(1 << i)).otherwise(0)
    return total


def clock_minutes(c: Column) -> Column:
    """Minute of the day of an 'HH:MM' text."""
    return F.substring(c, 1, 2).try_cast("int") * 60 + F.substring(c, 4, 2).try_cast("int")


def in_clock_range(minute: Column, start: Column, end: Column) -> Column:
    """Half open; an end at or before the start runs past midnight, equal ends are the whole day."""
    return F.when(start.isNull() | end.isNull(), True).when(end > start, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def in_season(day: Column, start: Column, end: Column) -> Column:
    """day, start and end as month * 100 + day, inclusive; the season may run past the year's end."""
    return F.when(start.isNull() | end.isNull(), True).when(end >= start, day.between(start, end)).otherwise((day >= start) | (day <= end))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6_371_008.8) -> Column:
    """Great-circle distance in metres of degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a straight segment in the plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length > 0, length)))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)
