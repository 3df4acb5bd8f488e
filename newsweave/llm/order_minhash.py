"""Near-duplicate documents by Order MinHash and banded alignment.

A text is its sequence of 5-word shingles, each labelled with how often it came before.
A sketch takes, for each of several hash functions, the few least labelled shingles in
the order of the text: it tends to agree where texts have the same passages in the same
order.  Texts with an equal sketch value are compared by a banded alignment of their
shingle sequences: ``shared / (n + m - shared)`` with the longest common subsequence as
shared has to reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.components import components
from newsweave.llm.shared import bitmap_of, bounded_batches, in_bitmap, written
from newsweave.llm.words import grams, mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
# Sketches per text and shingles in each: two texts of similarity 0.8 agree in one with
# probability 0.41, so that they miss each other in all with 0.00003.  Short texts agree less
# often (of 4 and 5 shingles 1 in 5) and get more sketches: they miss each other with 0.000001.
SKETCHES = 20
TAKEN = 4
SHORT, SHORT_SKETCHES = 25, 64
# Rounds in which buckets are compared with one of their texts, before all that is left is.
ROUNDS = 2
# Longs of the bitmap that bounds from below how many shingles two texts don't share.
PARITY = 32
_rng = np.random.default_rng(20)
_SEEDS = _rng.integers(0, 1 << 63, SHORT_SKETCHES, np.uint64)[:, None]
_FACTORS = (_rng.integers(0, 1 << 63, SHORT_SKETCHES, np.uint64) | np.uint64(1))[:, None]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles; of all words together where there are fewer."""
    return grams(words, min(SHINGLE, len(words))) if len(words) else words


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each shingle's hash together with its number among equal ones."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    first = np.flatnonzero(new)
    count = np.empty(len(hashes), np.uint64)
    count[order] = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    return mix(hashes + count * np.uint64(0x9E3779B97F4A7C15))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One value per hash function: its least labelled shingles, in the text's order."""
    labels = labelled(hashes)
    size = SHORT_SKETCHES if len(labels) <= SHORT else SKETCHES
    seeds, factors = _SEEDS[:size], _FACTORS[:size]
    keys = (labels ^ seeds) * factors
    keys ^= keys >> np.uint64(29)
    keys *= factors
    if len(labels) > TAKEN:
        at = np.sort(np.argpartition(keys, TAKEN - 1, axis=1)[:, :TAKEN], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(labels)), (size, len(labels)))
    out = seeds[:, 0].copy()
    for i in range(at.shape[1]):
        out = mix(out * np.uint64(31) + labels[at[:, i]])
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of the labelled shingles, a bit for whether an odd number of them falls on it.

    Bitmaps of two texts differ in no more bits than the texts have shingles apart.
    """
    at = labelled(hashes) >> np.uint64(64 - 11)
    odd = (np.bincount(at.astype(np.int64), minlength=PARITY * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Shared share of two shingle sequences by banded alignment; 0 where it is below the threshold.

    Offsets beyond the band leave too many shingles unmatched to reach the threshold.  The
    alignment keeps a row of the table in the bits of one integer.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n or n < threshold * m:
        return 0.0
    # shared >= need is the same as similarity >= threshold
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    known = np.intersect1d(labelled(a), labelled(b), assume_unique=True)
    if len(known) < need:
        return 0.0
    head = 0
    while head < n and a[head] == b[head]:
        step = min(n - head, 256)
        same = a[head : head + step] == b[head : head + step]
        head += step if same.all() else int(np.argmin(same))
        if not same.all():
            break
    tail, most = 0, n - head
    if most:
        same = a[n - most :][::-1] == b[m - most :][::-1]
        tail = most if same.all() else int(np.argmin(same))
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    shared = head + tail
    if x and y:
        places: dict[int, int] = {}
        for j, value in enumerate(y):
            places[value] = places.get(value, 0) | 1 << j
        band = max(n, m) - need
        full = (1 << len(y)) - 1
        row = full
        for i, value in enumerate(x):
            low, high = max(0, i - band), min(len(y), i + band + 1)
            near = places.get(value, 0)
            if near and high > low:
                near &= (1 << high) - (1 << low)
                if near:
                    kept = row & near
                    row = ((row + kept) | (row - kept)) & full
        shared += len(y) - row.bit_count()
    return shared / (n + m - shared) if shared >= need else 0.0


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, sketches, sizes, bitmaps, ends = [], [], [], [0], [], [0]
        for data in batch.column("text").to_pylist():
            hashes = shingles(words := word_hashes(data))
            counts.append(len(hashes))
            keys.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
            if len(words):
                sketches.append(sketch(hashes))
                bitmaps.append(parity(hashes))
            sizes.append(sizes[-1] + (len(sketches[-1]) if len(words) else 0))
            ends.append(len(bitmaps) * PARITY)
        values = np.concatenate(sketches).view(np.int64) if sketches else np.zeros(0, np.int64)
        bits = np.concatenate(bitmaps) if bitmaps else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(counts, pa.int32()),
                pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bits)),
            ],
            ["doc_id", "text_hash", "n", "words_key", "sketches", "parity"],
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        keep = [
            aligned_similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) > 0
            for x, y in zip(batch.column("words_a"), batch.column("words_b"), strict=True)
            for x, y in [(x.as_py(), y.as_py())]
        ]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def _shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) for the ids, the shingle hashes packed; one text is taken for each id.

    A bitmap of fixed size keeps most other texts from being hashed; a join decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, "id"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("id").to_numpy()
            near = pa.array(in_bitmap(shared.value, keys.view(np.uint64)))
            texts = batch.column("text").filter(near).to_pylist()
            packed = [shingles(word_hashes(x)).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(near), pa.array(packed, pa.binary())], ["id", "words"])

    texts = docs.select(_row_key().alias("id"), F.col("text").cast("binary"))
    packed = texts.mapInArrow(rows, "id long, words binary")
    return packed.join(ids.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])


def _row_key():
    """What tells texts apart: rows with one id and one text are one."""
    return F.xxhash64("doc_id", "text")


def _may_be_near():
    """Whether lengths and bitmaps let texts a and b reach the threshold: true for all that do."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    apart = F.lit(0)
    for i in range(PARITY):
        apart = apart + F.bit_count(F.col("bits_a")[f"b{i}"].bitwiseXOR(F.col("bits_b")[f"b{i}"]))
    fits = F.least(n_a, n_b) >= F.lit(THRESHOLD) * F.greatest(n_a, n_b)
    return fits & (apart <= (n_a + n_b) * F.lit((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-6)


def _sides(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """rows twice, as texts a and b, with the bitmap's longs as fields."""
    bits = F.struct(*(F.col("parity")[i].alias(f"b{i}") for i in range(PARITY)))
    rows = rows.withColumn("bits", bits)
    return tuple(rows.select(*(F.col(c).alias(f"{c}_{x}") for c in (*columns, "id", "n", "bits"))) for x in "ab")


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    packed = written(_shingles_of(docs, written(ids, "ids")), "shingles")
    left = packed.select(F.col("id").alias("a"), F.col("words").alias("words_a"))
    right = packed.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    return written(pairs.join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long"), "similar")


def _star_pairs(members: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's chosen text with its other members, those that may be near."""
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), "id", "component") if turn else F.struct("id", "component")
    chosen = written(members.groupBy("bucket").agg(F.min(order).alias("chosen")), "chosen")
    pairs = (
        members.join(chosen, "bucket")
        .where(F.col("component") != F.col("chosen.component"))
        .select(F.least("id", "chosen.id").alias("a"), F.greatest("id", "chosen.id").alias("b"))
        .distinct()
    )
    one, two = _sides(texts)
    sides = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
    return written(sides.where(_may_be_near()).select("a", "b"), "pairs")


def _open_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members, with their class by the links, of buckets that have more than one class."""
    classes = components(links)
    placed = members.select("bucket", "id").join(classes, "id", "left")
    placed = written(placed.select("bucket", "id", F.coalesce("component", "id").alias("component")), "placed")
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return written(placed.join(several.select("bucket"), "bucket"), "open")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, kept, has_words), one row per row of docs.

    Texts with the same words, letter case and punctuation aside, are copies of each other;
    texts are linked whose aligned similarity of 5-word shingles is 0.8 or more; a class is
    what links reach.  class_id is the least doc_id of the class, and kept is true for the
    rows that have it.  Texts without words (null, empty) are each a class of their own.  A
    null doc_id takes part but is never a class_id unless the whole class has none, where
    one text is kept.  Repeated rows are kept or go together; ties need no order.  Only doc_id
    and text are read.

    Copies are one text before anything is compared.  In a few rounds each bucket of equal
    sketch values that has several classes is compared with one of its texts, which joins large
    groups of near copies without making their pairs.  Texts of a bucket that are still in
    different classes are then compared with each other, all whose bitmaps let them reach the
    threshold, so no link between candidates is lost.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", _row_key().alias("text_hash"), F.col("text").cast("binary"))
    found = written(
        rows.mapInArrow(_sketch_rows, f"doc_id {kind}, text_hash long, n int, words_key binary, sketches array<long>, parity array<long>"),
        "sketches",
    )
    # The text of the least id stands for its copies.
    copies = found.where(F.col("n") > 0).groupBy("words_key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    texts = written(
        copies.agg(
            least.alias("least"), F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.first("parity").alias("parity")
        ).select("words_key", F.col("least.text_hash").alias("id"), F.col("least.doc_id").alias("doc_id"), "n", "sketches", "parity"),
        "texts",
    )
    members = texts.select("id", F.explode("sketches").alias("bucket"))
    shared = written(members.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    members = written(members.join(shared, "bucket").withColumn("component", F.col("id")), "members")

    links = None
    for turn in range(ROUNDS):
        found_links = _links(_star_pairs(members, texts, turn), docs)
        links = found_links if links is None else links.unionByName(found_links)
        members = _open_members(members, links)
        if members.isEmpty():
            break
    own = F.col("id") == F.col("text_id")
    members = members.join(texts.select(F.col("id").alias("text_id"), "n", "parity", "sketches"), own)
    one, two = _sides(members, "bucket", "component", "sketches")
    # A pair counts in the first of the buckets that it shares.
    shared = F.zip_with("sketches_a", "sketches_b", lambda x, y: F.when(x == y, x))
    rest = (
        one.join(two, F.col("bucket_a") == F.col("bucket_b"))
        .where((F.col("component_a") < F.col("component_b")) & _may_be_near())
        .where(F.filter(shared, lambda x: x.isNotNull())[0] == F.col("bucket_a"))
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .distinct()
    )
    links = links.unionByName(_links(written(rest, "open-pairs"), docs))
    final = components(links)

    placed_texts = texts.select("words_key", "id", "doc_id").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed_texts = written(placed_texts, "placed-texts")
    heads = placed_texts.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id")).alias("head")
    )
    classes = written(
        placed_texts.join(heads, "component").select(
            F.col("words_key").alias("key"), F.col("head.doc_id").alias("class_id"), F.col("head.id").alias("head")
        ),
        "heads",
    )
    result = found.select("doc_id", "text_hash", "words_key").join(classes, F.col("words_key") == F.col("key"), "left")
    alone = F.col("words_key").isNull()
    return result.select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("text_hash") == F.col("head"))).alias("kept"),
        (~alone).alias("has_words"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those whose class has an earlier document.

    Of repeated rows (equal doc_id and text) with words one is kept.
    """
    found = near_duplicates(docs)
    lost = found.where(~F.col("kept")).select(F.col("text_hash").alias("__lost")).distinct()
    repeated = found.where(F.col("kept") & F.col("has_words")).groupBy(F.col("text_hash").alias("__twice")).count().where("count > 1").select("__twice")
    kept = docs.withColumn("__key", _row_key()).join(lost, F.col("__key") == F.col("__lost"), "left_anti")
    twice = F.col("__key") == F.col("__twice")
    once = kept.join(repeated, twice, "left_anti")
    return once.unionByName(kept.join(repeated, twice, "left_semi").dropDuplicates(["__key"])).drop("__key")
