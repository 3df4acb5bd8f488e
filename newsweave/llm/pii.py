"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Built from column functions alone.  The patterns are possessive, and begin only where a run
of their first characters begins, so long runs are read once; they match what the plain
forms beside them match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[ -]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # Where an account number may begin; its end is told by mod-97.
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?=(?:[ -]?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
}
# A cheap test that a text without a match mostly fails.
_GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(PATTERNS["iban"]),
    "ssn": lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
# Words that, in the CONTEXT characters before a span, raise its score by RAISE.
CONTEXT_WORDS = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|addr|host|server|client",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|konto|cuenta|compte",
    "ssn": "ssn|social security",
}
CONTEXT = 40
RAISE = 0.2
# Spans of other kinds than the base ones need this score.
LEAST_SCORE = 0.5


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches, in code points, end exclusive."""
    steps = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(m.alias("match"), F.char_length(gap).alias("gap")),
    )
    kind = "array<struct<start:int,end:int,match:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def add(acc: Column, step: Column) -> Column:
        begin = acc["at"] + step["gap"]
        end = begin + F.char_length(step["match"])
        one = F.struct(begin.alias("start"), end.alias("end"), step["match"].alias("match"))
        # The piece after the last match has no match beside it.
        return F.when(step["match"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))
        )

    return F.aggregate(steps, start, add, lambda acc: acc["found"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$".replace("0*+", "0*"))
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def ibans(text: Column) -> Column:
    """Array of (start, end, match) of the account numbers, with single spaces or hyphens between their groups or none.

    A number without separators is taken as it is.  One in groups may be followed by other
    groups, so it ends at the last group with which it passes the check.
    """

    def number(x: Column) -> Column:
        # 34 characters and 33 separators, and the character after them
        window = F.regexp_extract(F.substring(text, x["start"] + 1, F.lit(68)), "^[A-Z0-9](?:[ -]?[A-Z0-9])*+", 0)
        plain = F.char_length(F.regexp_extract(window, "^[A-Z0-9]*+", 0))
        size = F.char_length(window)

        def passes(n: Column) -> Column:
            bare = F.translate(F.substring(window, F.lit(1), n), " -", "")
            ends = F.substring(window, n, F.lit(1)).rlike("[A-Z0-9]") & ~F.substring(window, n + 1, F.lit(1)).rlike("[A-Z0-9]")
            return F.when(ends & (n < 68) & F.char_length(bare).between(15, 34), mod97(bare)).otherwise(False)

        # The lookahead of the pattern makes the window 15 characters at least.
        ends = F.filter(F.concat(F.array(plain), F.sequence(size, F.lit(15), F.lit(-1))), passes)
        length = F.get(ends, F.lit(0))
        return F.struct(x["start"].alias("start"), (x["start"] + length).alias("end"), F.substring(window, F.lit(1), length).alias("match"))

    found = F.filter(F.transform(located(text, PATTERNS["iban"]), number), lambda x: x["end"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(acc: Column, x: Column) -> Column:
        before = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        return F.when(x["start"] >= before, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(found, none, add)


def _scored(text: Column, kind: str, span: Column) -> Column:
    before = F.greatest(span["start"] - CONTEXT, F.lit(0))
    near = F.lower(F.substring(text, before + 1, span["start"] - before))
    score = F.lit(_SCORES[kind]) + F.when(near.rlike(CONTEXT_WORDS[kind]), RAISE).otherwise(0.0)
    return F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score")
    )


def _kind_spans(text: Column, kind: str) -> Column:
    valid = ibans(text) if kind == "iban" else F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["match"]))
    spans = F.transform(valid, lambda x: _scored(text, kind, x))
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(_GATES[kind](text), spans).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, iban, ssn): per document the spans of each kind.

    A span is (kind, start, end, score), positions in code points and end exclusive, in the
    order of the text.  Spans of one kind don't overlap; those of different kinds may.  Null
    and empty texts have none.  Rows are independent: null and repeated ids and equal rows
    each get their own result, and columns other than doc_id and text aren't read.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *(_kind_spans(text, kind).alias(kind) for kind in KINDS))


def digest_text(*kinds: str) -> Column:
    """kind:start:end of the spans of the kinds, comma-joined."""
    each = F.transform(F.concat(*kinds), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(each, ",")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each stretch of personal data in text replaced by the name of its kind.

    Overlapping spans make one stretch, named after the first of them.  n_chars, where docs
    has it, follows the new text.  Null texts stay null; all other columns stay as they are.
    """
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumn("__spans", F.array_sort(F.concat(*(
        F.transform(_kind_spans(text, k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        for k in KINDS
    ))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        name = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, name).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        )

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))

    new = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, add, close)).otherwise(F.col("text"))
    out = marked.withColumn("text", new).drop("__spans")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars"))
    return out
