"""Dates, times of day and years of service.

Times of day are held as LongType microseconds since 00:00 (portable: Spark's TIME type needs
``spark.sql.timeType.enabled``). :func:`time_text` renders them.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions._util import col

_US_PER_SECOND = 1_000_000


def date_prefix(value: str | Column) -> Column:
    """Date from text of the form ``YYYY-MM-DD[ anything]``: the part before the first space is
    parsed strictly; anything unparsable gives null."""
    return F.try_to_date(F.substring_index(F.trim(col(value)), " ", 1), "yyyy-MM-dd")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` names it. Written out, a value
    that is split and split again is evaluated for each mention, and the code gets too long to be compiled."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fraction_micros(frac: Column) -> Column:
    # fraction digits padded / cut to 6: '2' -> 200000, '1234567' -> 123456; must be digits
    return F.when(frac.isNull() | (frac == ""), F.lit(0)).otherwise(
        F.when(frac.rlike("^[0-9]+$"), F.rpad(frac, 6, "0").try_cast("int"))
    )


def mmss_micros(value: str | Column) -> Column:
    """Parse ``MM:SS`` or ``MM:SS.f`` (minutes and seconds 0-59, fraction of any length) into
    microseconds since 00:00. Exactly one ``:`` is allowed; anything else gives null."""
    return _bind(F.split(F.trim(col(value)), ":"), lambda parts: F.when(F.size(parts) == 2, _hms_micros(F.lit(0), parts, 0)))


def _hms_micros(hours: Column, parts: Column, first: int) -> Column:
    """Of ``hours`` and the parts from ``first`` on, minutes and seconds."""
    numbers = lambda sec_parts: F.struct(
        F.size(sec_parts).alias("n"), hours.alias("hours"), F.get(parts, first).try_cast("int").alias("minutes"),
        F.get(sec_parts, 0).try_cast("int").alias("seconds"), _fraction_micros(F.get(sec_parts, 1)).alias("micros"),
    )
    return _bind(_bind(F.split(F.get(parts, first + 1), r"\."), numbers), _total_micros)


def _total_micros(t: Column) -> Column:
    ok = (
        (t["n"] <= 2)
        & t["hours"].between(0, 23)
        & t["minutes"].between(0, 59)
        & t["seconds"].between(0, 59)
        & t["micros"].isNotNull()
    )
    return F.when(ok, ((t["hours"].cast("long") * 60 + t["minutes"]) * 60 + t["seconds"]) * _US_PER_SECOND + t["micros"])


def time_micros(value: str | Column) -> Column:
    """Parse a time of day given as ``MM:SS[.f]`` (two parts) or ``HH:MM:SS[.f]`` (three parts)."""

    def parsed(parts: Column) -> Column:
        three = _hms_micros(F.get(parts, 0).try_cast("int"), parts, 1)
        return F.when(F.size(parts) == 2, _hms_micros(F.lit(0), parts, 0)).when(F.size(parts) == 3, three)

    return _bind(F.split(F.trim(col(value)), ":"), parsed)


def time_text(micros: str | Column) -> Column:
    """Render microseconds since 00:00 as ``HH:MM:SS`` or ``HH:MM:SS.ffffff`` (fraction only when
    non-zero)."""
    us = col(micros)
    secs = F.floor(us / _US_PER_SECOND)
    frac = us % _US_PER_SECOND

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    base = F.concat_ws(":", two(F.floor(secs / 3600)), two(F.floor(secs / 60) % 60), two(secs % 60))
    return F.when(us.isNotNull(), F.concat(base, F.when(frac > 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(F.lit(""))))


def service_years(hire_date: str | Column, as_of: str | Column | _dt.date) -> Column:
    """Whole years of service at ``as_of``: year difference, minus one when the (month, day) of the
    anniversary has not come yet, floored at 0; null without a hire date.

    Differs from ``months_between``: 2024-02-29 -> 2025-02-28 is 0 here.
    """
    h = col(hire_date)
    a = F.lit(as_of) if isinstance(as_of, _dt.date) else col(as_of)
    before_anniversary = (F.month(a) < F.month(h)) | (
        (F.month(a) == F.month(h)) & (F.dayofmonth(a) < F.dayofmonth(h))
    )
    years = F.year(a) - F.year(h) - F.when(before_anniversary, 1).otherwise(0)
    return F.when(h.isNotNull(), F.greatest(years, F.lit(0)))


# FIXED VALUES: service texts, as the entity rules word them (one for no date, zero, one, n years).
SERVICE_TEXT_NO_DATE = "Fecha de contratación no especificada."
SERVICE_TEXT_ZERO = "Menos de un año de antigüedad."
SERVICE_TEXT_ONE = "1 año de antigüedad."
SERVICE_TEXT_MANY_SUFFIX = " años de antigüedad."


def service_text(hire_date: str | Column, as_of: str | Column | _dt.date) -> Column:
    """Text for the years of service at ``as_of`` (4 cases)."""
    y = service_years(hire_date, as_of)
    return (
        F.when(y.isNull(), F.lit(SERVICE_TEXT_NO_DATE))
        .when(y == 0, F.lit(SERVICE_TEXT_ZERO))
        .when(y == 1, F.lit(SERVICE_TEXT_ONE))
        .otherwise(F.concat(y.cast("string"), F.lit(SERVICE_TEXT_MANY_SUFFIX)))
    )
