"""Secrets in texts and in what the texts encode.

A worklist begins with the text.  Every layer is scanned, then unwrapped: URL and Unicode
escapes are decoded in place, base64 tokens, compressed or not, become layers of their own.
Layers seen before are left, so the list ends.  Spans are positions in the original text; a
span inside a base64 token is the token, from where it may begin.  Tokens may be wrapped in
lines and joined to other words; no separate layer is made for each joint.  What a token holds is read in pieces, cut where no
secret or code can go on, so its size doesn't matter.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import codecs
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.shared import bounded_batches

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# An escape whose own mark is escaped more than three times over is one escape, so that no layer is needed for each level.
URL = r"%(?:(?:25){3,})?([0-9A-Fa-f]{2})"
UNICODE = r"\\u(?:(?:005[Cc]u){3,})?([0-9A-Fa-f]{4})"
BYTE = r"\\x(?:(?:5[Cc]x){3,})?([0-9A-Fa-f]{2})"
URL_RUN = re.compile(f"(?:{URL})+")
UNICODE_RUN = re.compile(f"(?:{UNICODE})+|(?:{BYTE})+")
URL_ESCAPE, UNICODE_ESCAPE, BYTE_ESCAPE = re.compile(URL), re.compile(UNICODE), re.compile(BYTE)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 that goes on over line ends, and where a token may begin behind other words.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE_END = re.compile(r"[\x20\t\r\n]+")
JOINT = re.compile(r"[+/_-]")
LEAST_TOKEN = 16
STANDARD = str.maketrans("-_", "+/")
# A layer is read in pieces of at most this many bytes.  They end at a byte that no pattern has; a layer without one in so
# many bytes is cut anyway, with the last OVERLAP bytes read again, and counted as not opened whole.
MOST_BYTES = 16 * 1024 * 1024
OVERLAP = 64 * 1024
NEUTRAL = re.compile(rb"[^A-Za-z0-9+/_.=\x20:\"'%\\-]")
# Compressed data is read, and content given out, about so many bytes at once.
CHUNK = 256 * 1024


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one layer."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def _escapes(run: str, escape: re.Pattern) -> tuple[list[str], list[int]]:
    """The digits of each escape of a run, and how long it is."""
    found = [(m[1], m.end() - m.start()) for m in escape.finditer(run)]
    return [digits for digits, _ in found], [length for _, length in found]


def _lengths(chars: str, units: list[int], lengths: list[int]) -> list[tuple[str, int]]:
    """The characters, each with the length of the escapes that it takes."""
    ends = list(itertools.accumulate(units, initial=0))
    total = list(itertools.accumulate(lengths, initial=0))
    return [(c, total[ends[i + 1]] - total[ends[i]]) for i, c in enumerate(chars)]


def _url_chars(run: str) -> list[tuple[str, int]]:
    """The characters of a run of URL escapes, with the length of each in the run; invalid bytes are U+FFFD."""
    digits, lengths = _escapes(run, URL_ESCAPE)
    decoded = bytes.fromhex("".join(digits)).decode(errors="surrogateescape")
    odd = ["\udc80" <= c <= "\udcff" for c in decoded]
    units = [1 if o else len(c.encode()) for c, o in zip(decoded, odd, strict=True)]
    return _lengths("".join("\ufffd" if o else c for c, o in zip(decoded, odd, strict=True)), units, lengths)


def _unicode_chars(run: str) -> list[tuple[str, int]]:
    """Likewise for Unicode escapes, with U+FFFD for lone surrogates."""
    if run[1] == "x":
        digits, lengths = _escapes(run, BYTE_ESCAPE)
        return [(chr(int(h, 16)), n) for h, n in zip(digits, lengths, strict=True)]
    digits, lengths = _escapes(run, UNICODE_ESCAPE)
    decoded = bytes.fromhex("".join(digits)).decode("utf-16-be", "surrogatepass")
    units = [2 if ord(c) > 0xFFFF else 1 for c in decoded]
    return _lengths("".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in decoded), units, lengths)


def _decoded_in_place(text: str, pattern: re.Pattern, chars) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with its escapes decoded, and where each character begins and ends in it."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        found = chars(m[0])
        starts.append(np.arange(at, m.start()))
        ends.append(np.arange(at + 1, m.start() + 1))
        parts.append(text[at : m.start()])
        edges = m.start() + np.cumsum([0, *(n for _, n in found)])
        starts.append(edges[:-1])
        ends.append(edges[1:])
        parts.append("".join(c for c, _ in found))
        at = m.end()
    if not parts:
        return None
    starts.append(np.arange(at, len(text)))
    ends.append(np.arange(at + 1, len(text) + 1))
    return "".join([*parts, text[at:]]), np.concatenate(starts), np.concatenate(ends)


class _Zstandard:
    """A Zstandard frame, read like the other kinds.

    Little is fed at once, as this decompressor doesn't bound what it gives back.
    """

    def __init__(self):
        self.frame, self.data, self.at = zstandard.ZstdDecompressor().decompressobj(), b"", 0

    @property
    def eof(self) -> bool:
        return self.frame.eof

    @property
    def needs_input(self) -> bool:
        return self.at >= len(self.data)

    @property
    def unused_data(self) -> bytes:
        return self.frame.unused_data + self.data[self.at :]

    def decompress(self, data: bytes, most: int) -> bytes:
        if data:
            self.data, self.at = self.data[self.at :] + data, 0
        fed = self.data[self.at : self.at + 256]
        self.at += len(fed)
        return self.frame.decompress(fed)


class _Deflate:
    """A gzip member or zlib stream, read like the other kinds."""

    def __init__(self, bits: int):
        self.stream = zlib.decompressobj(bits)

    @property
    def eof(self) -> bool:
        return self.stream.eof

    @property
    def needs_input(self) -> bool:
        return not self.stream.unconsumed_tail

    @property
    def unused_data(self) -> bytes:
        return self.stream.unused_data

    def decompress(self, data: bytes, most: int) -> bytes:
        return self.stream.decompress(self.stream.unconsumed_tail + data, most)


def _decompressor(head: bytes):
    """What reads compressed data, told by its first bytes; None for other data."""
    if head[:2] == b"\x1f\x8b":
        return _Deflate(31)
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return _Deflate(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstandard()
    return None


def _members(data: Iterator[bytes]) -> Iterator[bytes]:
    """The content of compressed members, one after the other, and as it is what isn't one."""
    rest, padded = b"", False
    while True:
        while len(rest) < 6 and (more := next(data, None)) is not None:
            rest += more
        if padded and _decompressor(bare := rest.lstrip(b"\0")):
            rest = bare
        if (member := _decompressor(rest)) is None:
            break
        taken, given, more = rest, False, rest
        try:
            while not member.eof:
                out = member.decompress(more, CHUNK)
                if out:
                    given, taken = True, b""
                    yield out
                more = b""
                if member.needs_input and not member.eof:
                    more = next(data, b"")
                    taken += b"" if given else more
                    if not more and not out:
                        # cut short
                        return
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError):
            rest = taken
            break
        # There may be zeros between members.
        rest, padded = member.unused_data, True
    if rest:
        yield rest
    yield from data


def _content(data: bytes) -> Iterator[bytes]:
    """The bytes of a token in chunks, decompressed as often as needed."""
    chunks: Iterator[bytes] = iter([data])
    before = set()
    while True:
        head = []
        size = 0
        for chunk in chunks:
            head.append(chunk)
            size += len(chunk)
            if size >= CHUNK:
                break
        first = b"".join(head)
        if _decompressor(first) is None:
            yield from _bytes_of_text(first, chunks)
            return
        # Data that holds itself has nothing new.
        digest = xxhash.xxh3_128_digest(first)
        if digest in before:
            return
        before.add(digest)
        chunks = _members(itertools.chain([first], chunks))


def _utf_16(head: bytes) -> str | None:
    """The kind of UTF-16 that data begins with: by its mark, or where NULs alternate."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if head[0] == 0xFF else "utf-16-be"
    head = head[: len(head[:4096]) // 2 * 2]
    even, odd, pairs = head[::2].count(0), head[1::2].count(0), len(head) // 2
    if pairs and max(even, odd) > 0.5 * pairs and min(even, odd) < 0.1 * pairs:
        return "utf-16-le" if odd > even else "utf-16-be"
    return None


def _bytes_of_text(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    """Data with UTF-16 made single bytes; ``?`` for other characters, which no pattern has."""
    kind = _utf_16(first)
    if kind is None:
        if first:
            yield first
        yield from rest
        return
    decoder = codecs.getincrementaldecoder(kind)("replace")
    for chunk in itertools.chain([first], rest):
        yield decoder.decode(chunk).encode("latin-1", "replace")


def _pieces(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The bytes in pieces that can be read by themselves, and whether one was cut where it shouldn't be."""
    held: list[bytes] = []
    size = 0
    for chunk in chunks:
        for at in range(0, len(chunk), max(MOST_BYTES // 2, 1)):
            part = chunk[at : at + max(MOST_BYTES // 2, 1)]
            held.append(part)
            size += len(part)
            if size < MOST_BYTES:
                continue
            data = b"".join(held)
            ends = next((m.end() for m in _backwards(data)), 0)
            if ends:
                yield data[:ends], False
                data = data[ends:]
            else:
                yield data, True
                data = data[-min(OVERLAP, MOST_BYTES // 2) :]
            held, size = [data], len(data)
    if size:
        yield b"".join(held), False


def _backwards(data: bytes) -> Iterator[re.Match]:
    """The last neutral byte of the data, looked for from its end."""
    step = 4096
    for end in range(len(data), 0, -step):
        found = None
        for found in NEUTRAL.finditer(data, max(0, end - step), end):
            pass
        if found:
            yield found


def _token_bytes(token: str) -> bytes | None:
    """The bytes that a base64 token stands for, without an odd character at its end."""
    bare = token.rstrip("=").translate(STANDARD)
    bare = bare[: len(bare) - (len(bare) % 4 == 1)]
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _from_base64(token: str) -> Iterator[tuple[str, bool]]:
    """The text that a token encodes, in pieces, and whether one was cut where it shouldn't be."""
    data = _token_bytes(token)
    # Patterns are of ASCII characters alone, so other bytes may be read as any others.
    for piece, cut in _pieces(_content(data)) if data else ():
        yield piece.decode("latin-1"), cut


def _opens(token: str) -> bool:
    """Whether a token begins with compressed data, told by its first bytes."""
    if _decompressor(_token_bytes(token[:8]) or b"") is None:
        return False
    head = _token_bytes(token[:256]) or b""
    try:
        _decompressor(head).decompress(head, 4096)
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError):
        return False
    return True


def _beginnings(token: str, lines: list[int]) -> Iterator[int]:
    """Where a token may begin in a run of its characters: at the start, behind a joint, in a new line.

    A base64 character is a quarter of three bytes, so one beginning per remainder by 4 reads the
    text of all others with it.  Compressed data has to be read from its own beginning, and what
    is behind one is taken for a part of it, unless it opens by itself.
    """
    yield 0
    read, packed = {0}, _opens(token[:256])
    joints = (m.end() for m in JOINT.finditer(token))
    for at in itertools.chain(lines, joints):
        if len(token) - at < LEAST_TOKEN:
            continue
        opens = _opens(token[at : at + 256])
        if opens or not packed and at % 4 not in read:
            read.add(at % 4)
            packed = packed or opens
            yield at


def _tokens(layer: str) -> Iterator[tuple[str, int, int]]:
    """What may be base64 in a layer, line ends taken out, with its start and end."""
    for m in BASE64.finditer(layer):
        for at in _beginnings(m[0], []):
            yield m[0][at:], m.start() + at, m.end()
    if "\n" not in layer:
        return
    for m in WRAPPED.finditer(layer):
        parts, lines, starts, at = [], [], [], m.start()
        size = 0
        for gap in LINE_END.finditer(layer, m.start(), m.end()):
            parts.append(layer[at : gap.start()])
            size += gap.start() - at
            at = gap.end()
            lines.append(size)
            starts.append(at)
        joined = "".join([*parts, layer[at : m.end()]])
        for begin in _beginnings(joined, lines):
            line = bisect.bisect_right(lines, begin)
            start = m.start() + begin if line == 0 else starts[line - 1] + begin - lines[line - 1]
            yield joined[begin:], start, m.end()


Layer = tuple[str, np.ndarray | None, np.ndarray | None]


def _inside(layer: str, starts: np.ndarray | None, ends: np.ndarray | None) -> Iterator[tuple[Layer, bool]]:
    """The layers in a layer, one at a time, and whether a token was first found to be cut."""
    fresh = []
    if "%" in layer:
        fresh.append(_decoded_in_place(layer, URL_RUN, _url_chars))
    if "\\" in layer:
        fresh.append(_decoded_in_place(layer, UNICODE_RUN, _unicode_chars))
    for new in fresh:
        if new is not None and new[0]:
            yield (new if starts is None else (new[0], starts[new[1]], ends[new[2] - 1])), False
    for token, first, last in _tokens(layer):
        start = first if starts is None else int(starts[first])
        end = last if ends is None else int(ends[last - 1])
        whole = True
        for inner, cut in _from_base64(token):
            # All of it is at the token; the arrays take no memory.
            yield (inner, np.broadcast_to(start, len(inner)), np.broadcast_to(end, len(inner))), cut and whole
            whole = whole and not cut


def secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans and all spans (start, kind, end), sorted, and how many layers couldn't be cut well."""
    text = text or ""
    base = sorted(scan(text))
    found, unopened = set(base), 0
    work = [_inside(text, None, None)]
    # Equal layers at different places are different secrets; one that returns to itself isn't new.
    seen = {(_digest(text), 0)}
    while work:
        step = next(work[-1], None)
        if step is None:
            work.pop()
            continue
        (layer, starts, ends), cut = step
        unopened += cut
        key = (_digest(layer), int(starts[0]))
        if key in seen:
            continue
        seen.add(key)
        found.update((int(starts[s]), k, int(ends[e - 1])) for s, k, e in scan(layer))
        work.append(_inside(layer, starts, ends))
    return base, sorted(_widest(found - set(base)) | set(base)), unopened


def _widest(found: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Of the spans of a kind with one end, the one that begins first: a token read from several beginnings is one."""
    first: dict[tuple[int, int], int] = {}
    for start, kind, end in found:
        first[kind, end] = min(start, first.get((kind, end), start))
    return {(start, kind, end) for (kind, end), start in first.items()}


def _digest(layer: str) -> bytes:
    return xxhash.xxh3_128_digest(layer.encode("utf-8", "surrogatepass"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    named = lambda spans: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]
    for batch in batches:
        results = [secrets(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([named(r[0]) for r in results], kind),
                pa.array([named(r[1]) for r in results], kind),
                pa.array([r[2] for r in results], pa.int64()),
            ],
            ["doc_id", "base", "spans", "unopened"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, unopened), one row per row of docs.

    ``base`` are the secrets in the text itself, ``spans`` those and the ones in decoded
    layers: (start, kind, end) in code points of the text, end exclusive, by start, then
    kind.  Null and empty texts have none.  ``unopened`` counts layers
    with 16 MB on end without a byte to cut at.  Rows are independent: null and repeated ids and
    equal rows each get their own result, and an empty table gives none; only doc_id and text are read.
    """
    bounded_batches(docs.sparkSession)
    span = "array<struct<start:int,kind:string,end:int>>"
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_rows, f"doc_id {kind}, base {span}, spans {span}, unopened long")


def digest_text(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
