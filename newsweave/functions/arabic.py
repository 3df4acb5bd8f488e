"""Arabic date text: detection, digits, time units, months, absolute dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, col, literal_map, replace_all
from .wordlists import (
    ARABIC_DIGITS,
    ARABIC_MONTHS,
    ARABIC_TIME_WORDS,
    ASCII_DIGITS,
    MONTHS,
)

DAY_MONTH_YEAR = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"


def is_arabic(c: ColumnOrName) -> Column:
    """At least half of the non-space characters are in the Arabic block."""
    c = col(c)
    arabic = F.length(F.regexp_replace(c, r"[^\x{600}-\x{6FF}]", ""))
    visible = F.length(F.regexp_replace(c, r"\s", ""))
    return F.coalesce((visible > 0) & (arabic * 2 >= visible), F.lit(False))


def translate_digits(c: ColumnOrName) -> Column:
    return F.translate(col(c), ARABIC_DIGITS, ASCII_DIGITS)


def translate_time_units(c: ColumnOrName) -> Column:
    """Longest word first, so that no word is broken by a shorter one inside it."""
    pairs = sorted(ARABIC_TIME_WORDS.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return replace_all(col(c), pairs)


def translate_months(c: ColumnOrName) -> Column:
    return replace_all(col(c), ARABIC_MONTHS.items())


def month_number(name: Column, *, loose: bool = False) -> Column:
    """Month 1-12 of an English name or three-letter abbreviation, else null.

    ``loose`` also takes ``Sept``, as free-text date readers do.
    """
    numbers: dict[str, int] = {}
    for number, month in enumerate(MONTHS, 1):
        numbers[month.lower()] = numbers[month[:3].lower()] = number
    if loose:
        numbers["sept"] = numbers["sep"]
    return F.try_element_at(literal_map(numbers), F.lower(name))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts, or null when there is no such day."""
    dash = F.lit("-")
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"),
        dash,
        F.lpad(month.cast("string"), 2, "0"),
        dash,
        F.lpad(day.cast("string"), 2, "0"),
    ).try_cast("date")


def parse_absolute_date(c: ColumnOrName) -> Column:
    """ISO date of the first "day month year" in the text, else null."""
    english = translate_months(translate_digits(c))
    day, month, year = (F.regexp_extract(english, DAY_MONTH_YEAR, i) for i in (1, 2, 3))
    return date_of(year, month_number(month), day).cast("string")


def translate_date(c: ColumnOrName) -> Column:
    """English form of an Arabic date; any other text is left as it is."""
    c = col(c)
    relative = translate_time_units(translate_digits(c))
    return F.when(is_arabic(c), F.coalesce(parse_absolute_date(c), relative)).otherwise(
        c
    )
