"""Building blocks of the SQL twins (DuckDB dialect).

Written from the operators' contracts with other means than the Spark side: rewriting
passes instead of look-around, cross joins instead of indexes.
"""

from __future__ import annotations

from newsweave.functions import dates, relevance, wordlists

from .views import AS_OF, TOKENS


AGO = "(^|[^a-z])ago([^a-z]|$)"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]::VARCHAR[]"


# -- text --------------------------------------------------------------------------


def unescape(c: str) -> str:
    """Entities that occur in the pages table; the ampersand itself comes last."""
    for pattern, char in [("&middot;", "·"), ("&quot;", '"'), ("&copy;", "©")]:
        c = f"replace({c}, {q(pattern)}, {q(char)})"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


def strip_tags(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]+>', '', 'g')"


def truncate(c: str) -> str:
    """``c`` is a column name."""
    head = f"substring({c}, 1, 500)"
    last = f"(501 - instr(reverse({head}), '.'))"
    return (
        f"CASE WHEN length({c}) <= 500 THEN {c} "
        f"WHEN {last} BETWEEN 2 AND 500 THEN substring({c}, 1, {last}) || ' ...' "
        f"ELSE {head} || '...' END"
    )


def utc_text(c: str) -> str:
    return f"strftime(make_timestamp({c}::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S UTC')"


# -- relevance ---------------------------------------------------------------------


def words(c: str) -> str:
    """Word tokens of a lower-cased text by rewriting it step by step."""
    for a, b in wordlists.SPLIT_WORDS:
        c = rf"regexp_replace({c}, '\b({a})({b})\b', '\1 \2', 'g')"
    wide = relevance.WIDE_CHARS
    c = f"translate({c}, {q(wide)}, {q(' ' * len(wide))})"
    c = rf"regexp_replace({c}, '[:,]([0-9])', chr(1) || '\1', 'g')"
    cut = relevance.CUT_CHARS.replace("'", "''")
    c = rf"regexp_replace({c}, '[:,{cut}{relevance.SPACE_CHARS}]|\.\.+|--+|''''+', ' ', 'g')"
    c = f"' ' || {c} || ' '"
    c = rf"regexp_replace({c}, '\.(''?) ', ' \1 ', 'g')"
    c = rf"regexp_replace({c}, '([^'' ])(?:''(?:s|m|d|ll|re|ve)?|n''t) ', '\1 ', 'g')"
    stop = strings(wordlists.STOP_WORDS)
    return (
        f"list_filter(string_split_regex({c}, ' +'), lambda w: "
        rf"regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AND NOT list_contains({stop}, w))"
    )


def ratio_of(w: str) -> str:
    return f"CASE WHEN len({w}) > 0 THEN len(list_distinct({w}))::DOUBLE / len({w}) ELSE 0e0 END"


def hits(text: str, phrases: str) -> str:
    one = f"((strlen({text}) - strlen(replace({text}, p, ''))) // strlen(p))"
    return f"coalesce(list_sum(list_transform({phrases}, lambda p: {one})), 0)::BIGINT"


def weighted(text: str, ratio: str, keywords: str = "keywords", phrases: str = "phrases") -> str:
    base = f"(10 * {hits(text, keywords)} + {hits(text, phrases)})::DOUBLE"
    return f"({base} * (1e0 + {ratio}))"


def combine(t: str, s: str, f: str) -> str:
    return (
        f"CASE WHEN {f} > 0 THEN ({t} * 3e0 + {s} * 2e0 + {f}) / 6e0 "
        f"ELSE ({t} * 2e0 + {s}) / 3e0 END"
    )


def final(content: str, bonus: str = "1e0") -> str:
    return f"floor(least({content} + {bonus}, 10e0) * 100e0 + 0.5e0) / 100e0"


def token_values(rows=TOKENS) -> str:
    """CTE body: one row per token, phrases lower-cased, empty ones left out."""
    out = []
    for i, (name, symbol, threshold, mandatory, additional, _) in enumerate(rows):
        keywords = [p.lower() for p in [name, symbol, *mandatory] if p]
        phrases = [p.lower() for p in additional if p]
        out.append(
            f"({i}, {q(symbol.lower())}, {6.5 if threshold is None else threshold}::DOUBLE, "
            f"{strings(keywords)}, {strings(phrases)})"
        )
    return (
        "SELECT * FROM (VALUES " + ", ".join(out)
        + ") v(idx, token_key, threshold, keywords, phrases)"
    )


def feature_ctes(source: str) -> str:
    """CTEs ``texts`` and ``features``: lower-cased fields and their word variety.

    ``source`` has title, snippet, full_content.
    """
    fields = {"t": "title", "s": "snippet", "f": "full_content"}
    lowered = ", ".join(f"lower(coalesce({c}, '')) AS {a}" for a, c in fields.items())
    split = ", ".join(f"{words(a)} AS w_{a}" for a in fields)
    ratios = ", ".join(f"{ratio_of('w_' + a)} AS r_{a}" for a in fields)
    return (
        f"texts AS (SELECT *, {lowered} FROM {source}), "
        f"worded AS (SELECT *, {split} FROM texts), "
        f"features AS (SELECT *, {ratios} FROM worded)"
    )


def scores(prefix: str = "") -> str:
    return ", ".join(f"{weighted(a, f'r_{a}')} AS s_{a}" for a in "tsf")


CONTENT = combine("s_t", "s_s", "s_f")
SCORE = final(CONTENT)

DOCUMENTS = """
SELECT doc_id, string_split(text, chr(10))[1] AS title, '/' || (doc_id % 40) AS link,
       text AS snippet, source, (1704067200 + (doc_id * 7919) % 2592000)::BIGINT AS timestamp,
       text AS full_content
FROM documents
"""
KEYED_DOCUMENTS = f"SELECT * REPLACE ('t' || (doc_id % 7) AS title) FROM ({DOCUMENTS})"
CLEANED_DOCUMENTS = (
    f"SELECT * REPLACE ({truncate('snippet')} AS snippet) FROM "
    f"(SELECT * REPLACE ({strip_tags('snippet')} AS snippet) FROM ({DOCUMENTS}))"
)

# -- dates -------------------------------------------------------------------------


def group(c: str, pattern: str, n: int) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {n})"


def number(c: str) -> str:
    return f"try_cast(nullif({c}, '') AS INTEGER)"


def month(c: str) -> str:
    names = [m.lower() for m in wordlists.MONTHS]
    short = [m[:3] for m in names]
    allowed = strings([*names, *short, "sept"])
    return f"CASE WHEN list_contains({allowed}, {c}) THEN list_position({strings(short)}, left({c}, 3)) END"


def date_of(y: str, m: str, d: str) -> str:
    return (
        f"try_cast(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' "
        f"|| lpad(({d})::VARCHAR, 2, '0') AS DATE)"
    )


def day_part(c: str) -> str:
    def form(f, named: bool) -> str:
        pattern, y, m, d = f
        mon = group(c, pattern, m)
        return date_of(
            number(group(c, pattern, y)),
            month(mon) if named else number(mon),
            number(group(c, pattern, d)),
        )

    a, b, y = (number(group(c, dates.NUMBERS, i)) for i in (1, 2, 3))
    numbers = f"CASE WHEN {a} > 12 THEN {date_of(y, b, a)} ELSE {date_of(y, a, b)} END"
    return "coalesce(" + ", ".join(
        [
            form(dates.YEAR_FIRST, False),
            numbers,
            form(dates.MONTH_DAY, True),
            form(dates.DAY_MONTH, True),
            form(dates.COMPACT, False),
        ]
    ) + ")"


def clock(c: str, ignore_offset: bool = False) -> str:
    h, mi, s, half, zone = (group(c, dates.TIME, i) for i in range(1, 6))

    def seconds(hour: str, minute: str, second: str) -> str:
        sec = f"coalesce({number(second)}, 0)"
        return (
            f"CASE WHEN {hour} < 24 AND {number(minute)} < 60 AND {sec} < 60 "
            f"THEN {hour} * 3600 + {number(minute)} * 60 + {sec} END"
        )

    hour = (
        f"(CASE WHEN {half} = '' THEN {number(h)} WHEN {number(h)} BETWEEN 1 AND 12 "
        f"THEN {number(h)} % 12 + CASE WHEN {half} = 'pm' THEN 12 ELSE 0 END END)"
    )
    named = " ".join(
        f"WHEN {zone} = {q(z)} THEN {hours * 3600}" for z, hours in wordlists.ZONE_HOURS.items()
    )
    digits = f"regexp_replace({zone}, '[^0-9]', '', 'g')"
    size = (
        f"({number(f'substring({digits}, 1, 2)')} * 3600 "
        f"+ {number(f'substring({digits}, 3, 2)')} * 60)"
    )
    offset = (
        f"CASE WHEN {zone} = '' THEN 0 {named} WHEN left({zone}, 1) = '-' THEN -{size} "
        f"ELSE {size} END"
    )
    spoken = seconds(hour, mi, s)
    if not ignore_offset:
        spoken = f"({spoken}) - ({offset})"
    ch, cm, cs = (group(c, dates.COMPACT_TIME, i) for i in (1, 2, 3))
    return (
        f"CASE WHEN {h} <> '' THEN {spoken} WHEN {ch} <> '' "
        f"THEN {seconds(number(ch), cm, cs)} ELSE 0 END"
    )


def leftover(c: str) -> str:
    for pattern in [
        dates.YEAR_FIRST[0],
        dates.NUMBERS,
        dates.MONTH_DAY[0],
        dates.DAY_MONTH[0],
        dates.COMPACT[0],
    ]:
        c = f"regexp_replace({c}, {q(pattern)}, ' ', 'g')"
    for pattern in [rf"t?{dates.TIME}", dates.FILLER]:
        c = f"regexp_replace({c}, {q(pattern)}, '', 'g')"
    return c


def absolute(c: str, *, ignore_offset: bool = False, strict: bool = False) -> str:
    """Epoch of a lower-cased text column."""
    epoch = (
        f"(datediff('day', DATE '1970-01-01', {day_part(c)})::BIGINT * 86400 "
        f"+ ({clock(c, ignore_offset)}))"
    )
    return f"CASE WHEN {leftover(c)} = '' THEN {epoch} END" if strict else epoch


def relative(c: str) -> str:
    n, unit = group(c, dates.RELATIVE, 1), group(c, dates.RELATIVE, 2)
    size = " ".join(f"WHEN {q(u)} THEN {s}" for u, s in wordlists.UNIT_SECONDS.items())
    return (
        f"CASE WHEN regexp_matches({c}, {q(AGO)}) "
        f"THEN {AS_OF}::BIGINT - {number(n)}::BIGINT * (CASE {unit} {size} END) END"
    )


def translate_date(c: str) -> str:
    """``c`` is a column name."""
    digits = f"translate({c}, {q(wordlists.ARABIC_DIGITS)}, {q(wordlists.ASCII_DIGITS)})"
    units, months = digits, digits
    pairs = sorted(wordlists.ARABIC_TIME_WORDS.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    for old, new in pairs:
        units = f"replace({units}, {q(old)}, {q(new)})"
    for old, new in wordlists.ARABIC_MONTHS.items():
        months = f"replace({months}, {q(old)}, {q(new)})"
    form = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    names = [m.lower() for m in wordlists.MONTHS]
    name = f"lower({group(months, form, 2)})"
    mon = (
        f"CASE WHEN list_contains({strings([*names, *(m[:3] for m in names)])}, {name}) "
        f"THEN list_position({strings(m[:3] for m in names)}, left({name}, 3)) END"
    )
    parsed = date_of(number(group(months, form, 3)), mon, number(group(months, form, 1)))
    arabic = (
        rf"(length(regexp_replace({c}, '[^\x{{600}}-\x{{6FF}}]', '', 'g')) * 2 >= "
        rf"length(regexp_replace({c}, '\s', '', 'g')) "
        rf"AND length(regexp_replace({c}, '\s', '', 'g')) > 0)"
    )
    return f"CASE WHEN {arabic} THEN coalesce(({parsed})::VARCHAR, {units}) ELSE {c} END"


def parsed_dates(source: str, text: str) -> str:
    """CTEs ending in ``parsed``: source plus ``translated``, ``epoch``, ``ago``."""
    return f"""
tr AS (SELECT *, {translate_date(text)} AS translated FROM {source}),
lo AS (SELECT *, lower(translated) AS low FROM tr),
parsed AS (SELECT *, regexp_matches(low, {q(AGO)}) AS ago,
                  CASE WHEN regexp_matches(low, {q(AGO)}) THEN {relative('low')}
                       ELSE {absolute('low')} END AS epoch
           FROM lo)"""


DATE_SOURCE = (
    "CASE WHEN epoch IS NULL THEN 'fallback' WHEN ago THEN 'relative' ELSE 'absolute' END"
)
