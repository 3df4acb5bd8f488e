from newsweave.functions.arabic import (
    is_arabic,
    parse_absolute_date,
    translate_date,
    translate_digits,
    translate_time_units,
)


def test_is_arabic(column):
    texts = ["مرحبا", "Hello", "١٢٣", "123", "", None, "مرحبا hello hello"]
    assert column(texts, is_arabic("t")) == [True, False, True, False, False, False, False]


def test_digits(column):
    texts = ["١٢٣", "٠٩٨٧٦٥٤٣٢١", "مرحبا ٣ عالم"]
    assert column(texts, translate_digits("t")) == ["123", "0987654321", "مرحبا 3 عالم"]


def test_time_units_after_digits(column):
    texts = ["قبل ساعتين", "قبل ٣ أيام", "قبل سنة"]
    read = translate_time_units(translate_digits("t"))
    assert column(texts, read) == ["ago hours", "ago 3 days", "ago year"]


def test_duals_and_plurals_stay_whole(column):
    texts = ["يومين", "أسبوعين", "شهرين", "أشهر"]
    assert column(texts, translate_time_units("t")) == ["days", "weeks", "months", "months"]


def test_relative_dates(column):
    texts = ["قبل ٣ ساعات", "قبل ٢ أسابيع", "قبل ١٢ يوم", "قبل ساعتين", "2 hours ago", "vor 2 Stunden"]
    assert column(texts, translate_date("t")) == [
        "ago 3 hours",
        "ago 2 weeks",
        "ago 12 day",
        "ago hours",
        "2 hours ago",
        "vor 2 Stunden",
    ]


ABSOLUTE = ["٤ ديسمبر ٢٠٢٤", "١٥ يناير ٢٠٢٣", "٢٨ فبراير ٢٠٢٥"]
ISO = ["2024-12-04", "2023-01-15", "2025-02-28"]


def test_absolute_dates(column):
    assert column(ABSOLUTE, parse_absolute_date("t")) == ISO
    assert column(["٣١ فبراير ٢٠٢٥", "4 Dec 2024", "4 Foo 2024"], parse_absolute_date("t")) == [
        None,
        "2024-12-04",
        None,
    ]


def test_absolute_dates_by_the_full_path(column):
    texts = [*ABSOLUTE, "4 December 2024"]
    assert column(texts, translate_date("t")) == [*ISO, "4 December 2024"]
