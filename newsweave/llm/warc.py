"""WARC bundles of independent Zstandard frames with a footer seek table.

Records are grouped into frames that decompress alone.  A bundle ends with a skippable
frame that lists the sizes of its frames, so any reader finds frames without an index; the
index maps record identifiers to a frame and an offset inside it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.shared import bounded_batches, written
from newsweave.session import shared_folder

# Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 1024 * 1024 * 1024
# Compressed bytes that one task reads back, about.
READ_BYTES = 64 * 1024 * 1024
LEAST_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
ID = "urn:newsweave:page:"
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<{ID}{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    number = record_id.strip("<>")[len(ID) :]
    return int(number) if number else None


def _one_line(url: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """The bytes of a response record, or of a revisit record that refers to the page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]),
        *([f"WARC-Refers-To: {_id(first)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of one record; the payload's bytes are checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


class BundleWriter:
    """Writes records into frames of one bundle, and its seek table at the end."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.fs, self.path, self.sizes, self.pending, self.held = fs, path, [], [], 0
        self.out, self.offset = fs.open_output_stream(path, compression=None), 0
        self.zip = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame number, offset inside the frame and length of the record."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self.flush()
        at = (len(self.sizes), self.held, len(data))
        self.pending.append(data)
        self.held += len(data)
        return at

    def flush(self) -> None:
        if self.pending:
            frame = self.zip.compress(b"".join(self.pending))
            self.out.write(frame)
            self.sizes.append((len(frame), self.held))
            self.offset += len(frame)
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame of a bundle."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(end - 9 - 8 * n)
    data, frames, offset = source.read(8 * n), [], 0
    for small, large in struct.iter_unpack("<II", data):
        frames.append((offset, small, large))
        offset += small
    return frames


_INDEX = "page_id long, bundle string, frame int, frame_bytes int, offset int, length int"


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, first_id, revisit) rows as bundles; the index of what was written.

    Each attempt of a task writes files of its own name, and the index names those of the
    attempts that ended well; others are never read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get().partitionId()
        names = iter(lambda: f"{path}/{task:06d}-{uuid.uuid4().hex}.warc.zst", None)
        writer, index = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id", "revisit")), strict=True):
                if writer is None:
                    writer = BundleWriter(fs, next(names))
                index.append((row[0], *writer.add(record(*row))))
                if writer.offset >= BUNDLE_BYTES:
                    yield from closed(writer, index)
                    writer, index = None, []
        if writer is not None:
            yield from closed(writer, index)

    def closed(writer: BundleWriter, index: list[tuple]) -> Iterator[pa.RecordBatch]:
        writer.close()
        scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
        name = folder.rstrip("/") + "/" + writer.path.rsplit("/", 1)[1] if scheme else writer.path
        columns = list(zip(*index, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                pa.array([name] * len(index), pa.string()),
                pa.array(columns[1], pa.int32()),
                pa.array([writer.sizes[f][0] for f in columns[1]], pa.int32()),
                pa.array(columns[2], pa.int32()),
                pa.array(columns[3], pa.int32()),
            ],
            ["page_id", "bundle", "frame", "frame_bytes", "offset", "length"],
        )

    bounded_batches(records.sparkSession)
    return written(records.mapInArrow(rows, _INDEX), "warc-index")


_FIELDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def read_bundles(index: DataFrame) -> DataFrame:
    """The records of index rows, read from their bundles: a frame is decompressed once for its rows."""
    frames = index.groupBy("bundle", "frame").agg(
        F.first("frame_bytes").alias("frame_bytes"), F.collect_list(F.struct("offset", "length")).alias("records")
    )
    total = index.groupBy("bundle", "frame").agg(F.first("frame_bytes").alias("b")).agg(F.sum("b")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, total // READ_BYTES + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list] = {}
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(row["bundle"])
                with fs.open_input_file(path) as source:
                    if path not in tables:
                        tables = {path: seek_table(source)}
                    offset, small, large = tables[path][row["frame"]]
                    data = unzip.decompress(source.read_at(small, offset), max_output_size=large)
                found = [parsed(data[r["offset"] : r["offset"] + r["length"]]) for r in row["records"]]
                yield pa.RecordBatch.from_pylist(found, _FIELDS)

    return frames.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(
        rows,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def lookup(index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of the page_ids alone: only their frames are read."""
    return read_bundles(index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi"))


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of pages (page_id, url, html), and return the index.

    The payload is the html in UTF-8, empty where it is null.  Of records with equal payloads
    that with the least page_id is the response, the others revisit it.  Rows repeated with the
    least page_id are all responses; a row without a page_id is one only where no row with its
    payload has a page_id.  A null url is left out, control characters in it are escaped.
    An empty table gives an empty index.  Other columns aren't read.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    firsts = written(rows.groupBy("digest").agg(F.min("page_id").alias("first_id")), "first-pages")
    other = ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.length("payload") >= LEAST_REVISIT_BYTES)
    records = rows.join(firsts, "digest").select("page_id", "url", "payload", "first_id", other.alias("revisit"))
    return write_bundles(records, folder)
