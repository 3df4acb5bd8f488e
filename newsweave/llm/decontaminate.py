"""Benchmark decontamination by winnowed fingerprints.

Documents and benchmark items keep the least hash of every six successive 5-word grams.
A shared run of ten words holds six such grams, so both sides keep the same one of them:
windows around a fingerprint that the benchmark may have are the only ones to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.shared import bitmap_of, bounded_batches, in_bitmap, written
from newsweave.llm.words import grams, word_hashes

WINDOW = 10
GRAM = 5


def fingerprints(words: np.ndarray, window: int = WINDOW, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing keeps, the rightmost of equal ones."""
    hashes = grams(words, k)
    span = window - k + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, span):
        other = hashes[i : i + n]
        better = other <= least
        np.copyto(least, other, where=better)
        np.copyto(at, np.arange(i, i + n), where=better)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    at = np.unique(at)
    return at, hashes[at]


def candidate_windows(
    words: np.ndarray, bits: np.ndarray, short: list[int], window: int = WINDOW, k: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each window that may be in the benchmark."""
    found = []
    at, hashes = fingerprints(words, window, k)
    at = at[in_bitmap(bits, hashes)]
    if len(at):
        starts = np.unique(at[:, None] - np.arange(window - k + 1))
        starts = starts[(starts >= 0) & (starts <= len(words) - window)]
        found.append((starts, window, grams(words, window)[starts]))
    for length in short:
        hashes = grams(words, length)
        starts = np.flatnonzero(in_bitmap(bits, hashes))
        found.append((starts, length, hashes[starts]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return (
        np.concatenate([x[0] for x in found]),
        np.concatenate([np.full(len(x[0]), x[1]) for x in found]),
        np.concatenate([x[2] for x in found]),
    )


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lengths, windows, keys = [], [], [], []
        for item, data in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = word_hashes(data)
            length = min(WINDOW, len(words))
            if not length:
                continue
            own = np.unique(grams(words, length))
            ids += [item] * len(own)
            lengths += [length] * len(own)
            windows.append(own)
            keys += [fingerprints(words)[1].view(np.int64).tolist() if length == WINDOW else own.view(np.int64).tolist()]
            keys += [[]] * (len(own) - 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.string()),
                pa.array(lengths, pa.int32()),
                pa.array(np.concatenate(windows).view(np.int64) if windows else [], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["item_id", "len", "window", "keys"],
        )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id as text, len, window, keys) for each distinct window of each item; keys: what to look for."""
    texts = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return texts.mapInArrow(_item_rows, "item_id string, len int, window long, keys array<long>")


def document_windows(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, windows): per document, the windows that may be in the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes, parts = [], [0], []
            for data in batch.column("text").to_pylist():
                words = word_hashes(data)
                found = candidate_windows(words, shared.value, short)
                counts.append(len(words))
                sizes.append(sizes[-1] + len(found[0]))
                if len(found[0]):
                    parts.append(found)
            column = lambda i, kind: np.concatenate([p[i] for p in parts]).astype(kind) if parts else np.zeros(0, kind)
            struct = pa.StructArray.from_arrays(
                [
                    pa.array(column(0, np.int32)),
                    pa.array(column(1, np.int32)),
                    pa.array(column(2, np.uint64).view(np.int64)),
                ],
                ["at", "len", "window"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct),
                ],
                ["doc_id", "text_hash", "n_words", "windows"],
            )

    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(
        rows,
        f"doc_id {kind}, text_hash long, n_words long, windows array<struct<at:int,len:int,window:long>>",
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items), one row per row of docs.

    ``spans`` are (start, end) word positions of all windows of the benchmark in the text,
    sorted; ``items`` the ids of the items that have them, as sorted strings.  Both are
    empty for clean texts.  Null and empty texts have no words.  Items without words match
    nothing; an item without an id gives spans but isn't listed; rows with one id are one
    item.  Repeated documents get equal rows.  Only doc_id, item_id and text are read, so
    other columns may have any names.

    The least hashes go to the tasks as a bitmap of fixed size, which can only let more
    windows through; which of them are the benchmark's is decided by a join.
    """
    windows = written(benchmark_windows(benchmark), "benchmark-windows")
    bits = bitmap_of(windows.select(F.explode("keys").alias("key")), "key")
    short = [r["len"] for r in windows.where(F.col("len") < WINDOW).select("len").distinct().collect()]
    known = windows.groupBy("len", "window").agg(F.collect_set("item_id").alias("ids"))

    found = written(document_windows(docs, bits, sorted(short)), "document-windows")
    hits = (
        found.select("doc_id", "text_hash", F.inline("windows"))
        .join(known, ["len", "window"])
        .groupBy("doc_id", "text_hash")
        .agg(
            F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("end")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        )
        .withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    spans = "array<struct<start:int,end:int>>"
    return found.join(hits, same, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("spans", F.array().cast(spans)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(spans: str = "spans"):
    """How many word positions sorted (start, end) spans cover."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    bad = (
        contamination(docs, benchmark)
        .where(F.size("spans") > 0)
        .select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
        .distinct()
    )
    same = F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("text") == F.col("__bad_hash"))
    return docs.join(bad, same, "left_anti")
