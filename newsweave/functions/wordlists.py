"""Results depend on these exact lists, so they are spelled out.

Nothing here is logic.  Each list is in its natural order.
"""

from __future__ import annotations

# English stop words.  Only purely alphabetic entries are listed,
# because a token holding an apostrophe never reaches the stop-word test.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves
he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on
off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now d ll m o re ve y
ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan
shouldn wasn weren won wouldn
""".split()

# Contracted words a Penn-Treebank tokenizer cuts in two.
SPLIT_WORDS = [
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
]

# The ten Arabic-Indic digits, zero to nine.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"

# Arabic time-unit words (singular, dual, plural) and "ago".
ARABIC_TIME_WORDS = {
    "ثانية": "second",
    "ثانيتين": "seconds",
    "ثواني": "seconds",
    "دقيقة": "minute",
    "دقيقتين": "minutes",
    "دقائق": "minutes",
    "ساعة": "hour",
    "ساعتين": "hours",
    "ساعات": "hours",
    "يوم": "day",
    "يومين": "days",
    "أيام": "days",
    "أسبوع": "week",
    "أسبوعين": "weeks",
    "أسابيع": "weeks",
    "شهر": "month",
    "شهرين": "months",
    "أشهر": "months",
    "سنة": "year",
    "سنتين": "years",
    "سنوات": "years",
    "قبل": "ago",
}

# Arabic month names, January to December.
ARABIC_MONTHS = {
    "يناير": "January",
    "فبراير": "February",
    "مارس": "March",
    "أبريل": "April",
    "مايو": "May",
    "يونيو": "June",
    "يوليو": "July",
    "أغسطس": "August",
    "سبتمبر": "September",
    "أكتوبر": "October",
    "نوفمبر": "November",
    "ديسمبر": "December",
}

# English month names, January to December.
MONTHS = (
    "January February March April May June July August September October "
    "November December"
).split()

# Seconds per time unit; a month is 30 days and a year 365.
UNIT_SECONDS = {
    "second": 1,
    "minute": 60,
    "hour": 3600,
    "day": 86400,
    "week": 7 * 86400,
    "month": 30 * 86400,
    "year": 365 * 86400,
}

# The named zones of RFC 822 mail dates, in hours from UTC.
ZONE_HOURS = {
    "z": 0,
    "ut": 0,
    "utc": 0,
    "gmt": 0,
    "est": -5,
    "edt": -4,
    "cst": -6,
    "cdt": -5,
    "mst": -7,
    "mdt": -6,
    "pst": -8,
    "pdt": -7,
}

# Meta tags that may hold a publication date, most trusted first.
META_DATE_TAGS = [
    ("property", "article:published_time"),
    ("name", "pubdate"),
    ("name", "publication_date"),
    ("name", "date"),
    ("itemprop", "datePublished"),
]

# The placeholder address that stands for a chain's native coin.
NATIVE_ADDRESS = "0xEeeeeEeeeEeEeeEeEeEeeEEEeeeeEeeeeeeeEEeE"
