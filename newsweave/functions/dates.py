"""Relative and absolute dates in text, as epoch seconds (UTC).

The readable forms are a closed list.  A text that matches none of them, or names
a day or time that does not exist, gives null; callers fall back to ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arabic import date_of, month_number, translate_date
from .columns import ColumnOrName, bind, blank_to_null, col, literal_map
from .wordlists import MONTHS, UNIT_SECONDS, ZONE_HOURS

_UNITS = "|".join(UNIT_SECONDS)
RELATIVE = rf"(\d+)\s*({_UNITS})s?"
# A digit may be glued to the word on either side, a letter not.
AGO = r"(?<![a-z])ago(?![a-z])"

_MONTH = "(" + "|".join(m[:3].lower() + "[a-z]*" for m in MONTHS) + ")"
# Date forms, lower case, in the order they are tried: the pattern and the numbers
# of its year, month and day groups.
YEAR_FIRST = (r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3)
NUMBERS = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"
MONTH_DAY = (rf"\b{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", 3, 1, 2)
DAY_MONTH = (
    rf"\b(\d{{1,2}})(?:st|nd|rd|th)?[-\s]+(?:of\s+)?{_MONTH}\.?,?[-\s]+(\d{{4}})\b",
    3,
    2,
    1,
)
COMPACT = (r"\b(\d{4})(\d{2})(\d{2})(?:t?\d{4}(?:\d{2})?)?z?\b", 1, 2, 3)
# Years of two digits; a colon behind them makes them an hour.
SHORT_NUMBERS = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})\b(?![-/.:])"
SHORT_DAY_MONTH = (rf"\b(\d{{1,2}})[-\s]+{_MONTH}\.?,?[-\s]+(\d{{2}})\b(?!:)", 3, 2, 1)
# Dates with parts left out, which the reference time fills in.
NO_YEAR = [
    (rf"\b{_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?!:)", 1, 2),
    (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?[-\s]+(?:of\s+)?{_MONTH}\b", 2, 1),
]
NO_DAY = rf"\b{_MONTH}\.?,?\s+(\d{{4}})\b"
COMPACT_TIME = r"\b\d{8}t?(\d{2})(\d{2})(\d{2})?"

_ZONES = "|".join(ZONE_HOURS)
TIME = (
    r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([ap]m\b)?"
    rf"\s*((?:{_ZONES})\b|[+-]\d{{2}}:?\d{{2}})?"
)
# Words a strict reading skips beside the date and the time.
FILLER = (
    r"\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\b|\b(?:at|on|and|of|t)\b|[,;.\s]"
)

EPOCH_MIN, EPOCH_MAX = -62135596800, 253402300799  # years 1 to 9999


def _number(c: Column) -> Column:
    return blank_to_null(c).try_cast("int")


def _by_groups(text: Column, form, month_names: bool) -> Column:
    pattern, y, m, d = form
    month = F.regexp_extract(text, pattern, m)
    return date_of(
        _number(F.regexp_extract(text, pattern, y)),
        month_number(month, loose=True) if month_names else _number(month),
        _number(F.regexp_extract(text, pattern, d)),
    )


def _by_numbers(text: Column) -> Column:
    """nn/nn/yyyy, month first unless the first number cannot be a month."""
    numbers = F.array(*(_number(F.regexp_extract(text, NUMBERS, i)) for i in (1, 2, 3)))
    return bind(
        numbers,
        lambda n: F.when(n[0] > 12, date_of(n[2], n[1], n[0])).otherwise(
            date_of(n[2], n[0], n[1])
        ),
    )


def _century(year: Column) -> Column:
    """The year of two digits: 1970 to 2069."""
    return year + F.when(year < 70, 2000).otherwise(1900)


def _by_short_year(text: Column) -> Column:
    """nn/nn/yy as nn/nn/yyyy, or day, month name and yy."""
    numbers = F.array(*(_number(F.regexp_extract(text, SHORT_NUMBERS, i)) for i in (1, 2, 3)))
    pattern, y, m, d = SHORT_DAY_MONTH
    return F.coalesce(
        bind(
            numbers,
            lambda n: F.when(n[0] > 12, date_of(_century(n[2]), n[1], n[0])).otherwise(
                date_of(_century(n[2]), n[0], n[1])
            ),
        ),
        date_of(
            _century(_number(F.regexp_extract(text, pattern, y))),
            month_number(F.regexp_extract(text, pattern, m), loose=True),
            _number(F.regexp_extract(text, pattern, d)),
        ),
    )


def _by_parts(text: Column, reference: Column) -> Column:
    """Month and year with the reference's day, the month's last at most; or month and day
    with its year."""
    now = F.to_date(F.timestamp_seconds(reference))
    first = date_of(
        _number(F.regexp_extract(text, NO_DAY, 2)),
        month_number(F.regexp_extract(text, NO_DAY, 1), loose=True),
        F.lit(1),
    )
    whole_month = F.least(F.date_add(first, F.dayofmonth(now) - 1), F.last_day(first))
    return F.coalesce(
        whole_month,
        *(
            date_of(
                F.year(now),
                month_number(F.regexp_extract(text, pattern, m), loose=True),
                _number(F.regexp_extract(text, pattern, d)),
            )
            for pattern, m, d in NO_YEAR
        ),
    )


def date_part(lowered: Column, reference: Column | None = None) -> Column:
    """Day of the first date form found in a lower-cased text, else null.

    ``reference`` is the time that parts left out are taken from; without it such dates
    aren't read.
    """
    partial = [] if reference is None else [_by_parts(lowered, reference)]
    return F.coalesce(
        _by_groups(lowered, YEAR_FIRST, False),
        _by_numbers(lowered),
        _by_groups(lowered, MONTH_DAY, True),
        _by_groups(lowered, DAY_MONTH, True),
        _by_groups(lowered, COMPACT, False),
        _by_short_year(lowered),
        *partial,
    )


def _clock(lowered: Column, ignore_offset: bool) -> Column:
    """Seconds after midnight UTC; 0 without a time, null for a bad time."""
    found = F.array(*(F.regexp_extract(lowered, TIME, i) for i in range(1, 6)))
    compact = F.array(*(F.regexp_extract(lowered, COMPACT_TIME, i) for i in (1, 2, 3)))

    def spoken(t: Column) -> Column:
        hour = _number(t[0])
        hour = (
            F.when(t[3] == "", hour)
            .when(hour.between(1, 12), hour % 12 + F.when(t[3] == "pm", 12).otherwise(0))
        )
        seconds = _of_day(hour, t[1], t[2])
        return seconds if ignore_offset else seconds - _offset(t[4])

    return F.when(lowered.rlike(TIME), bind(found, spoken)).when(
        lowered.rlike(COMPACT_TIME),
        bind(compact, lambda t: _of_day(_number(t[0]), t[1], t[2])),
    ).otherwise(F.lit(0))


def _of_day(hour: Column, minute: Column, second: Column) -> Column:
    """Seconds after midnight, or null when there is no such time."""
    minute, second = _number(minute), F.coalesce(_number(second), F.lit(0))
    valid = (hour < 24) & (minute < 60) & (second < 60)
    return F.when(valid, hour * 3600 + minute * 60 + second)


def _offset(zone: Column) -> Column:
    """Seconds east of UTC of ``+hh:mm``, ``-hhmm`` or a named zone; 0 for ''."""
    named = literal_map({name: hours * 3600 for name, hours in ZONE_HOURS.items()})
    digits = F.regexp_replace(zone, "[^0-9]", "")
    size = F.coalesce(
        _number(F.substring(digits, 1, 2)) * 3600
        + _number(F.substring(digits, 3, 2)) * 60,
        F.lit(0),
    )
    signed = F.when(zone.startswith("-"), -size).otherwise(size)
    return F.coalesce(F.try_element_at(named, zone), signed)


def _leftover(lowered: Column) -> Column:
    whole = [YEAR_FIRST[0], NUMBERS, MONTH_DAY[0], DAY_MONTH[0], COMPACT[0]]
    for pattern in [*whole, SHORT_NUMBERS, SHORT_DAY_MONTH[0]]:
        lowered = F.regexp_replace(lowered, pattern, " ")
    # the T of an ISO date-time stays behind, glued to the time
    for pattern in [rf"t?{TIME}", FILLER]:
        lowered = F.regexp_replace(lowered, pattern, "")
    return lowered


def absolute_epoch(
    c: ColumnOrName,
    *,
    ignore_offset: bool = False,
    strict: bool = False,
    reference: Column | None = None,
) -> Column:
    """Epoch of the date (and time) found in a text, else null.

    ``ignore_offset`` reads the wall time as UTC; otherwise offsets and the RFC 822
    zone names are applied.  ``strict`` wants nothing else in the text.
    With a ``reference`` time, dates without a year or a day are read as well.
    """

    def read(text: Column) -> Column:
        seconds = F.unix_date(date_part(text, reference)).cast("bigint") * 86400 + _clock(
            text, ignore_offset
        )
        if strict:
            seconds = F.when(_leftover(text) == "", seconds)
        return seconds

    return bind(F.lower(col(c)), read)


def is_relative(c: ColumnOrName) -> Column:
    return F.lower(col(c)).rlike(AGO)


def relative_epoch(c: ColumnOrName, as_of: Column) -> Column:
    """``as_of`` minus the first number and unit of an "ago" text, else null."""
    lowered = F.lower(col(c))
    count = _number(F.regexp_extract(lowered, RELATIVE, 1)).cast("bigint")
    unit = F.regexp_extract(lowered, RELATIVE, 2)
    epoch = as_of - count * F.try_element_at(literal_map(UNIT_SECONDS), unit)
    return F.when(is_relative(c) & (epoch >= EPOCH_MIN), epoch)


def parse_date(c: ColumnOrName, as_of: Column, *, ignore_offset: bool = False) -> Column:
    """Date text to ``struct<timestamp: bigint, date_source: string>``.

    Arabic text is translated first.  A text with "ago" is read as a relative
    date only, any other as an absolute one; what cannot be read is ``as_of``.
    """
    translated = translate_date(F.coalesce(col(c), F.lit("")))

    def read(text: Column) -> Column:
        ago = is_relative(text)
        epoch = F.when(ago, relative_epoch(text, as_of)).otherwise(
            absolute_epoch(text, ignore_offset=ignore_offset, reference=as_of)
        )
        return bind(
            epoch,
            lambda e: F.struct(
                F.coalesce(e, as_of).alias("timestamp"),
                F.when(e.isNull(), "fallback")
                .when(ago, "relative")
                .otherwise("absolute")
                .alias("date_source"),
            ),
        )

    return bind(translated, read)


def feed_epoch(published: ColumnOrName, updated: ColumnOrName, as_of: Column) -> Column:
    """Feed entry time: published, else updated, else ``as_of``; offsets apply."""
    return F.coalesce(absolute_epoch(published), absolute_epoch(updated), as_of)
