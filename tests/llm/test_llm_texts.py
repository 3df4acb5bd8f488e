"""Decontamination, personal data and secrets against brute force over small texts."""

import base64
import bz2
import gzip
import lzma
import random
import re
import time
import zlib
from urllib.parse import quote

import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from newsweave.llm import decontaminate, pii, secret_scan

DOCS = "doc_id long, text string, spans string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], DOCS)


# Decontamination


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    words, hit, found = tokens(text), set(), set()
    for item, item_text in items:
        own = tokens(item_text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination_is_that_of_all_windows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "béta", "Gamma", "d", "e5", "zeta"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(2, items[3][1]), (None, " ".join(word() for _ in range(12))), (30, None), (31, "... !")]
    texts = [None, "", "!!!"]
    for _ in range(60):
        text = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            at, part = rng.randint(0, len(text)), tokens(rng.choice(items)[1])
            start = rng.randint(0, max(0, len(part) - 10))
            text[at:at] = [w.upper() for w in part[start : start + rng.randint(5, 20)]]
        texts.append(", ".join(text))
    texts += texts[3:6]
    docs = docs_of(spark, texts).unionByName(spark.createDataFrame([(3, texts[3], "x", None), (None, texts[4], "x", None)], DOCS))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("windows", F.lit(1))
    got = decontaminate.contamination(docs, benchmark).withColumn("n", decontaminate.covered()).toPandas()
    ours = sorted(((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.n, list(r["items"])) for _, r in got.iterrows()), key=str)
    want = [(i, *brute_hits(t, items)) for i, t in [*enumerate(texts), (3, texts[3]), (None, texts[4])]]
    assert ours == sorted(want, key=str)
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, _, n, _ in want if not n), key=str)


def test_contamination_of_empty_tables(spark):
    docs = docs_of(spark, ["a b c"])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).select("n_words", F.size("spans")).first() == (3, 0)
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(divmod(int(c) * (1 + i % 2), 10))
    return total % 10 == 0


def brute_personal(text):
    out = {kind: [] for kind in BASE}
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


PERSONAL = [
    None, "", "a@b.c_d@e.f.g, x@y", "é ñ 😀 mail me: j.doe+x@mail.example.org!", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.0255 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111", "+49 (30) 1234-5678 and +1 23 and +1234567890123456",
    "++1 (2) 3.4-5 67 89", "1" * 5000 + ".1.1.1 " + "a" * 5000 + "@ " + "a." * 3000 + "@b." + "c." * 3000 + "d",
    "IBAN: GB82WEST12345698765432, DE89370400440532013000, DE89370400440532013001", "my SSN: 078-05-1120, id 078-05-1120",
]


def test_personal_data_is_that_of_the_plain_patterns(spark):
    rng = random.Random(6)
    texts = PERSONAL + ["".join(rng.choice("ab1.@+- 40(é") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        for kind, spans in brute_personal(text).items():
            assert [(x.start, x.end) for x in got[i][kind]] == spans, (kind, text)
    assert [PERSONAL[9][x.start : x.end] for x in got[9].iban] == ["GB82WEST12345698765432", "DE89370400440532013000"]
    assert [PERSONAL[10][x.start : x.end] for x in got[10].ssn] == ["078-05-1120"] * 2
    assert got[3].email[0].score > got[2].email[0].score


def test_no_ssn_without_context(spark):
    assert pii.personal_data(docs_of(spark, ["part number 078-05-1120"])).first().ssn == []


PRINTED = [
    ("IBAN DE89 3704 0044 0532 0130 00.", ["DE89 3704 0044 0532 0130 00"], []),
    ("GB82-WEST-1234-5698-7654-32 BIC NWBKGB2L", ["GB82-WEST-1234-5698-7654-32"], []),
    ("pay BE68 5390 0754 7034 NOW OR NEVER, 😀 DE89 37040044 0532013000", ["BE68 5390 0754 7034", "DE89 37040044 0532013000"], []),
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"], []),
    ("DE89 3704 0044 0532 0130 01, DE89  3704 0044 0532 0130 00 XDE89370400440532013000 " + "DE89370400440532013000" * 3, [], []),
    ("AB12 " * 500 + "DE89370400440532013000", ["DE89370400440532013000"], []),
    ("my ssn-078-05-1120 or SSN 078-05-1120--, ssn 1078-05-1120 078-05-11203", [], ["078-05-1120"] * 2),
]


def test_printed_account_numbers_and_ssn(spark):
    got = {r.doc_id: r for r in pii.personal_data(docs_of(spark, [t for t, _, _ in PRINTED])).collect()}
    for i, (text, iban, ssn) in enumerate(PRINTED):
        assert [text[x.start : x.end] for x in got[i].iban] == iban, text
        assert [text[x.start : x.end] for x in got[i].ssn] == ssn, text
    masked = {r.doc_id: r.text for r in pii.masked(docs_of(spark, [t for t, _, _ in PRINTED])).collect()}
    assert masked[0] == "IBAN <IBAN>." and masked[6].startswith("my ssn-<SSN> or SSN <SSN>--")


def test_masking(spark):
    docs = docs_of(spark, ["mail a@b.cd or +49 30 1234567 é", None, "", "nothing", "1.2.3.4"]).withColumn("text2", F.lit("a@b.cd"))
    rows = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert rows[0].text == "mail <EMAIL> or <PHONE> é" and rows[0].n_chars == len(rows[0].text) and rows[0].text2 == "a@b.cd"
    assert [rows[i].text for i in range(1, 5)] == [None, "", "nothing", "<IP>"]
    assert pii.masked(docs).columns == docs.columns


# Secrets


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


KEY = "AKIA" + "Q" * 16
HIDDEN = [
    (f"see {quote('password=hunter22', safe='')} ok", "assign", "password%3Dhunter22"),
    ("x " + quote("password=hunter22").replace("p", "%70", 1) + " é", "assign", "%70assword%3Dhunter22"),
    ("😀 \\u0073ecret: abcdef1 .", "assign", "\\u0073ecret: abcdef1"),
    (f"blob {b64('the key ' + KEY + ' is here')} end", "access", None),
    (f"blob {b64(gzip.compress(('token=' + 'f' * 30).encode()))} end", "assign", None),
    (f"blob {b64(zlib.compress(b64('my api_key = zzzzzz99 here!').encode()))} end", "assign", None),
    (f"blob {quote(b64('secret: ' + 'ab12' * 9)).replace('=', '%3D')} end", "hex", None),
]


@pytest.mark.parametrize("text, kind, span", HIDDEN)
def test_hidden_secrets(text, kind, span):
    base, spans, unopened = secret_scan.secrets(text)
    assert not base and not unopened
    found = [text[s:e] for s, k, e in spans if secret_scan.KINDS[k] == kind]
    # an encoded token's padding may be escaped itself, and is part of its span only then
    blob = text.split()[1]
    assert found == [span] if span else found and all(blob.startswith(x) and len(blob) - len(x) <= 3 for x in found)


def test_worklist_ends_on_cycles_and_keeps_places():
    twice = b64("password = swordfish")
    text = f"{twice} and {twice} 100%25252541 {'%' * 50} \\u005cu0041"
    _, spans, _ = secret_scan.secrets(text)
    assert sorted((s, e) for s, _, e in spans) == [(0, len(twice)), (len(twice) + 5, 2 * len(twice) + 5)]


def test_large_layers_are_counted(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_BYTES", 1000)
    assert secret_scan.secrets(b64(gzip.compress(b"a" * 5000)))[2] == 1


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_later_members(pack):
    hidden = [b"nothing much", b"token=" + b"g" * 30, KEY.encode(), b"f" * 30]
    for after in (pack(hidden[3]), hidden[3]):
        text = "x " + b64(b"".join(pack(h) for h in hidden[:3]) + after)
        _, spans, unopened = secret_scan.secrets(text)
        assert {k for _, k, _ in spans} == {0, 1, 2} and not unopened
        assert {text[s:e] for s, _, e in spans} == {text.split()[1]}


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_large_layers_are_read_whole(monkeypatch, pack):
    monkeypatch.setattr(secret_scan, "MOST_BYTES", 1000)
    lines = [f"line {i}, of no use" for i in range(2000)]
    lines[700], lines[1999] = f"secret: {'%41' * 8}", f"so {b64('the ' + KEY)}"
    lines[1200] = f"{b64(pack((chr(10).join(lines[:20]) + ' token=abcdefgh').encode()))}"
    _, spans, unopened = secret_scan.secrets(b64(pack("\n".join(lines).encode())))
    assert {k for _, k, _ in spans} == {0, 1} and not unopened


LINE = "user é; secret: abcdef1"
ODD_DATA = [
    "\ufeff" + LINE, "\xa0" + LINE, "\xad\u200d" + LINE, "\f" + LINE, "\0\0" + LINE, "\x1b[31m" + LINE, LINE.encode("latin-1"),
    LINE.encode("utf-16"), LINE.encode("utf-16-le"), LINE.encode("utf-16-be"), ("😀 " + LINE).encode("utf-16"), b"\xe9 " + b64(LINE.encode("utf-16-le")).encode(),
]


@pytest.mark.parametrize("data", ODD_DATA)
def test_odd_characters_hide_nothing(data):
    for text in (f"a {b64(data)} b", f"a {b64(gzip.compress(data if isinstance(data, bytes) else data.encode()))} b"):
        assert [text[s:e] for s, _, e in secret_scan.secrets(text)[1]] == [text.split()[1]]


@pytest.mark.parametrize("before, after", [("%E9", ""), ("", "%ff%C3"), ("\\ud83d", ""), ("", "\\udc00\\ud83d\\ude00")])
def test_odd_escapes_hide_nothing(before, after):
    hidden = "token=abcdefgh"
    coded = "".join(f"\\u{ord(c):04x}" if "\\" in before + after else f"%{ord(c):02x}" for c in hidden)
    text = f"é {before}{coded}{after} end"
    assert [text[s:e] for s, _, e in secret_scan.secrets(text)[1]] == [coded]


def test_truncated_members():
    rng = random.Random(1)
    packed = gzip.compress(("password=hunter22 " + " ".join(str(rng.random()) for _ in range(900))).encode())
    assert [k for _, k, _ in secret_scan.secrets(b64(packed[: len(packed) // 2]))[1]] == [0]


def test_base_secrets(spark):
    texts = [
        None, "", 'PASSWORD = "abc123" token:abcde secret:=x', "api-key: abcdefg, apikey='abcdefg', ſecret: abcdefg", f"{KEY} {KEY[:19]}",
        "f" * 23 + " " + "0" * 24 + "g" + "a1" * 20, "token=" + "a" * 40_000,
    ]
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(spark, texts)).collect()}
    words = lambda i, kind: [texts[i][x.start : x.end] for x in got[i].base if x.kind == kind]
    assert got[0].base == got[1].base == []
    assert words(2, "assign") == ['PASSWORD = "abc123']
    assert words(3, "assign") == ["apikey='abcdefg"]
    assert words(4, "access") == [KEY]
    assert words(5, "hex") == ["0" * 24, "a1" * 20]
    assert [(x.start, x.kind, x.end) for x in got[6].base] == [(0, "assign", 40_006), (6, "hex", 40_006)]


@pytest.mark.parametrize("mark, level", [("%", "25"), ("\\u", "005cu"), ("\\x", "5cx")])
def test_deep_escapes_take_no_layer_for_each_level(mark, level):
    last = {"%": "3D", "\\u": "003d", "\\x": "3d"}[mark]
    for depth in (0, 1, 2, 3, 4, 5, 100_000 // len(level)):
        text = f"see token{mark}{level * depth}{last}zyxwvuts, and more"
        started = time.process_time()
        _, spans, _ = secret_scan.secrets(text)
        assert "token" + text.split("token")[1].split(",")[0] in [text[s:e] for s, k, e in spans if k == 0]
        assert time.process_time() - started < 3


def test_escapes_of_several_units_keep_their_places():
    text = "a %252525C3%A9%E2%82%AC%FF \\ud83d\\u005cu005cu005cude00\\ud800 token%3Dabcdefg"
    _, spans, _ = secret_scan.secrets(text)
    assert [text[s:e] for s, k, e in spans if k == 0] == ["token%3Dabcdefg"]


def test_escapes_are_decoded_as_by_the_library():
    rng = random.Random(9)
    for _ in range(500):
        word = "".join(chr(rng.choice([65, 233, 8364, 0x1F600, 37, 92])) for _ in range(rng.randint(1, 6)))
        coded = quote(word, safe="") if rng.random() < 0.5 else "".join(f"\\u{x:04x}" for x in _units(word))
        pattern, chars = (secret_scan.URL_RUN, secret_scan._url_chars) if coded[0] != "\\" else (secret_scan.UNICODE_RUN, secret_scan._unicode_chars)
        if pattern.fullmatch(coded):
            found = chars(coded)
            assert "".join(c for c, _ in found) == word and sum(n for _, n in found) == len(coded)


def _units(word):
    data = word.encode("utf-16-be")
    return [int.from_bytes(data[i : i + 2]) for i in range(0, len(data), 2)]


BURIED = b"password: hunter2-is-hidden " * 6


def wrapped(data: bytes, width: int, end: str = "\n") -> str:
    text = base64.b64encode(data).decode()
    return end.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("data", [BURIED, gzip.compress(BURIED + random.Random(7).randbytes(300)), zlib.compress(BURIED + random.Random(7).randbytes(300)), bz2.compress(BURIED)])
@pytest.mark.parametrize("width, end", [(76, "\n"), (64, "\r\n"), (61, "\n  ")])
def test_tokens_wrapped_in_lines(data, width, end):
    text = f"see:\n{wrapped(data, width, end)}\n\nand more"
    spans = secret_scan.secrets(text)[1]
    assert any(k == 0 and text[s:e].startswith(wrapped(data, width, end)[:20]) for s, k, e in spans)


@pytest.mark.parametrize("before", ["https://x.com/cb/", "v1-", "a_b-c+", "/one/two/three/", "key-abc_de/"])
@pytest.mark.parametrize("data", [BURIED, gzip.compress(BURIED), zlib.compress(BURIED)])
@pytest.mark.parametrize("encode", [base64.b64encode, base64.urlsafe_b64encode])
def test_tokens_joined_to_other_words(before, data, encode):
    token = encode(data).decode()
    text = f"go {before}{token} there"
    assert any(k == 0 and text[s:e].endswith(token) or token.startswith(text[s:e][:8]) for s, k, e in secret_scan.secrets(text)[1])


def test_tokens_with_words_behind_them():
    token = base64.b64encode(b"password: hunter2-is-hidden").decode().rstrip("=")
    for tail in ("/", "/cb", "-x", "_abc", "/a/b/c"):
        assert [k for _, k, _ in secret_scan.secrets(f"{token}{tail}")[1]] == [0]


def test_many_joints_take_linear_time():
    """Runs of joints, and of what looks like compressed data behind them."""
    for unit in ("/", "-ab", "eJw/", "H4sI/", "word-\n", "aaaaaaaaaaaaaaaaaaaa\n"):
        begin = time.monotonic()
        secret_scan.secrets(unit * (200_000 // len(unit)))
        assert time.monotonic() - begin < 8


def test_secrets_of_repeated_and_no_rows(spark):
    text = "x v1-" + base64.b64encode(BURIED).decode()
    got = secret_scan.find_secrets(docs_of(spark, [text, text, None, ""])).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1]
    assert secret_scan.find_secrets(docs_of(spark, ["x"]).limit(0)).count() == 0
