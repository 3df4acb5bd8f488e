"""Scores of documents under a trigram model kept in Elias-Fano tries.

Words are numbered by falling count.  A count is then a step function of the number, given
by one row for each different count, of which N tokens have at most sqrt(2N): the unigram
level, and all that is broadcast.  Trigrams (u, v, w) are kept as (v, w, u), so that a bigram
stands beside its trigrams, in slices of about ``SLICE_TOKENS`` training tokens along this order; the cuts
follow from the counts alone, and a frequent word is cut along its followers.  A slice is
one trie: words, pointers, followers, pointers, words before them, each level a rising
sequence, with quantised weights beside the nodes.

Probabilities are Dirichlet-smoothed: p(w|uv) = (c(uvw) + B p(w|v)) / (c(uv) + B) and
p(w|v) = (c(vw) + A p(w)) / (c(v) + A), p(w) being the base.  The trigram's node holds the
logarithm of the numerator, the bigram's that of the numerator of unseen trigrams below it,
and of the denominator of what follows it.

Documents are read once, into blocks with numbers local to a block.  Each block sends a
slice its distinct trigrams with the documents that hold them; the slice builds its trie of the
training counts, looks all trigrams up in it, and gives back one sum per document.

Null and empty texts have one token, the end.  Repeated rows are documents of their own.
Where nothing is trained on, all scores are those of an empty model: log10(1) = 0.  An empty
table gives no rows.  A task holds a block of about ``BLOCK_TOKENS`` tokens, or one document
if that is longer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.elias_fano import Trie
from newsweave.llm.numbering import numbered
from newsweave.llm.shared import bounded_batches, written

BLOCK_TOKENS = 2_000_000
SLICE_TOKENS = 2_500_000
# Bytes of a long text that are split into words at once.
PIECE = 4 * 1024 * 1024
# Words longer than this are known by their 128-bit hash.  No word holds a space.
LONGEST = 24
END = b" "
# Weights of the lower order: tokens that the base and the bigram count for.
A, B = 300.0, 2.0
ADDED = 0.1
# Logarithms are kept in steps of 1/1024, from -32 up.
STEP, LOWEST = 1024, -32
_SPACE = re.compile(rb"[\t-\r ]")


# -- words ---------------------------------------------------------------------------


def words(data: bytes) -> Iterator[bytes]:
    """A-Z lower-cased words; ``bytes.split`` cuts at exactly the six ASCII blanks."""
    start = 0
    while start < len(data):
        end = start + PIECE
        if end < len(data):
            blank = _SPACE.search(data, end)
            end = blank.start() if blank else len(data)
        yield from data[start:end].lower().split()
        start = end


def _known_by(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b" " + xxhash.xxh3_128_digest(word)


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers as zstd-compressed planes of their bytes."""
    parts = [zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T), 1) for a in arrays]
    head = [len(arrays), *chain.from_iterable((len(a), a.itemsize, len(p)) for a, p in zip(arrays, parts))]
    return np.array(head, np.int64).tobytes() + b"".join(parts)


def _unpacked(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, np.int64, 1)[0])
    heads = np.frombuffer(data, np.int64, 3 * count, 8).reshape(-1, 3).tolist()
    at, out = 8 + 24 * count, []
    for n, width, size in heads:
        planes = np.frombuffer(zstandard.decompress(data[at : at + size]) if n else b"", np.uint8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"i{width}").reshape(n))
        at += size
    return out


def blocks(docs: DataFrame, doc_id: str, text: str, trained: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``block, words, counts, tokens, docs``: texts as numbers of a block's own word list.

    ``counts`` are those of training documents; ``docs`` is an array of id, tokens (the end
    included) and whether the document is one to train on.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = pa.schema({"block": pa.int64(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "tokens": pa.binary()})
    ddl = f"block long, words array<binary>, counts array<long>, tokens binary, docs array<struct<id:{kind},n:int,trained:boolean>>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 33, 0
        ids: dict[bytes, int] = {END: 0}
        tokens, held = [], []

        def block() -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            use = np.repeat([h["trained"] for h in held], [h["n"] for h in held])
            counts = np.bincount(flat[use], minlength=len(ids))
            columns = [[part + number], [[_known_by(w) for w in ids]], [counts], [_packed(flat)]]
            arrays = [pa.array(c, t) for c, t in zip(columns, schema.types)]
            out = pa.RecordBatch.from_arrays(arrays, schema=schema)
            offsets = pa.array([0, len(held)], pa.int32())
            fields = [pa.array([h[f] for h in held], t) for f, t in (("id", id_type), ("n", pa.int32()), ("trained", pa.bool_()))]
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["id", "n", "trained"]))
            return out.append_column("docs", listed)

        total = 0
        for batch in batches:
            id_type = batch.schema.types[0]
            for doc, data, train in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.fromiter(chain((ids.setdefault(w, len(ids)) for w in words(data or b"")), (0,)), np.int32)
                tokens.append(found)
                held.append({"id": doc, "n": len(found), "trained": train})
                total += len(found)
                if total >= block_tokens:
                    yield block()
                    ids, tokens, held, total, number = {END: 0}, [], [], 0, number + 1
        if tokens:
            yield block()

    rows = docs.select(F.col(doc_id), F.col(text).cast("binary"), F.coalesce(trained, F.lit(False)))
    return rows.toDF("id", "text", "trained").mapInArrow(made, ddl)


# -- the unigram level ---------------------------------------------------------------


@dataclass(frozen=True)
class Counts:
    """Counts of words numbered by falling count: one entry for each different count."""

    firsts: np.ndarray  # the first number of each step
    counts: np.ndarray
    before: np.ndarray  # tokens of all words in front of a step
    known: int  # different words
    tokens: int
    documents: int
    slice_tokens: int = SLICE_TOKENS

    @property
    def unknown(self) -> int:
        """The number of every word not trained on; one more is the start of a text."""
        return self.known

    @property
    def start(self) -> int:
        return self.known + 1

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of each word; a text's start is counted once a document."""
        step = np.searchsorted(self.firsts, ids, "right") - 1
        out = self.counts[step] if len(self.counts) else np.zeros(len(ids), np.int64)
        out = np.where(ids == self.unknown, 0, out)
        return np.where(ids == self.start, self.documents, out)

    def ahead(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of the words in front of known words."""
        step = np.searchsorted(self.firsts, ids, "right") - 1
        return self.before[step] + (ids - self.firsts[step]) * self.counts[step]

    def base(self, ids: np.ndarray) -> np.ndarray:
        return (self.of(ids) + ADDED) / (self.tokens + ADDED * (self.known + 1))

    def unseen(self, v: np.ndarray, w: np.ndarray, seen: np.ndarray | int = 0) -> np.ndarray:
        """p(w|v) where the pair was met ``seen`` times."""
        return (seen + A * self.base(w)) / (self.of(v) + A)

    def slices(self) -> int:
        return max(1, math.ceil(self.tokens / self.slice_tokens))

    def slice_of(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The slice of a known pair: grows along (v, w), with as many tokens in each as words foretell."""
        front = np.where(v == self.start, self.tokens, self.ahead(np.minimum(v, self.known - 1)))
        at = front + self.of(v) * (self.ahead(w) / self.tokens)
        return np.minimum((at / (self.tokens + self.documents) * self.slices()).astype(np.int64), self.slices() - 1)


def vocabulary(blocks: DataFrame, slice_tokens: int = SLICE_TOKENS) -> tuple[DataFrame, Counts]:
    """``word, id`` of the trained words, and the steps of their counts."""
    each = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    known = each.where("counts > 0").groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c"))
    known = numbered(known, [F.desc("c"), F.col("word")], "id", "vocabulary")
    steps = known.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    counts = np.array([s["c"] for s in steps], np.int64)
    n = np.array([s["n"] for s in steps], np.int64)
    documents = blocks.select(F.sum(F.size(F.filter("docs", lambda d: d["trained"])))).first()[0] or 0
    before = np.cumsum(np.r_[0, counts * n])
    firsts = np.cumsum(np.r_[0, n])
    return known.select("word", "id"), Counts(
        firsts[:-1], counts, before[:-1], int(firsts[-1]), int(before[-1]), documents, slice_tokens
    )


def dictionaries(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``block, dictionary``: places in the block's word list that are known words, and their numbers."""
    each = blocks.select("block", F.posexplode("words").alias("at", "word"))
    found = each.join(known, "word").select("block", "at", "id").repartition("block").sortWithinPartitions("block")

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def closed() -> pa.RecordBatch:
            data = _packed(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data])], ["block", "dictionary"])

        for batch in batches:
            b, at, number = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            for start, end in zip(cuts, [*cuts[1:], len(b)]):
                if held and b[start] != block:
                    yield closed()
                    held = []
                block = int(b[start])
                held.append((at[start:end].copy(), number[start:end].copy()))
        if held:
            yield closed()

    return found.mapInArrow(collected, "block long, dictionary binary")


# -- slices --------------------------------------------------------------------------


def _code(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x - LOWEST) * STEP), 0, 65535).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return code / STEP + LOWEST


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of the columns begins."""
    changes = [c[1:] != c[:-1] for c in columns]
    return np.flatnonzero(np.r_[True, np.logical_or.reduce(changes)]) if len(columns[0]) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``starts``."""
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


@dataclass
class Weighted:
    """A trie of one slice with the weights of its nodes."""

    trie: Trie
    trigram: np.ndarray  # log10 of the numerator
    unseen: np.ndarray  # the same for trigrams below the bigram that aren't there
    context: np.ndarray  # log10 of the denominator of what follows the bigram

    @classmethod
    def build(cls, v: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, counts: Counts) -> Weighted:
        """Of distinct trigrams, sorted by (v, w, u), with their counts."""
        first = _runs(v, w)
        seen = _sums(c, first)
        lower = counts.unseen(v[first], w[first], seen)
        pair = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))
        return cls(
            Trie.build(v, w, u), _code(np.log10(c + B * lower[pair])), _code(np.log10(B * lower)), _code(np.log10(seen + B))
        )

    def weights(self, v: np.ndarray, w: np.ndarray, pair: np.ndarray, u: np.ndarray, counts: Counts):
        """Of trigrams, given by their places in distinct pairs: numerators; and the pairs' denominators."""
        at = self.trie.pairs(v, w)
        there = at >= 0
        below = np.log10(B * counts.unseen(v, w))
        below[there] = _value(self.unseen[at[there]])
        after = np.full(len(v), _value(_code(np.log10([B])))[0])
        after[there] = _value(self.context[at[there]])
        found = self.trie.tuples(at[pair], u)
        weight = below[pair]
        hit = found >= 0
        weight[hit] = _value(self.trigram[found[hit]])
        return weight, after


def _trigrams(coded: DataFrame, counts: Counts) -> DataFrame:
    """``slice, block, payload, own``: what a block asks of each slice, and what it knows by itself.

    The latter, one row a block that any slice hands on, are the figures of its documents and
    the part of their scores that no slice knows of: starts and unknown words.
    """
    ddl = "slice long, block long, payload binary, own boolean"
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    names = ["slice", "block", "payload", "own"]
    empty = math.log10(B)

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block, n_words, tokens, lens, trained, dictionary = (batch.column(i)[at].as_py() for i in range(6))
                yield from one(block, n_words, tokens, np.array(lens, np.int64), np.array(trained, bool), dictionary)

    def one(block, n_words, tokens, lens, trained, dictionary) -> Iterator[pa.RecordBatch]:
        ids = np.full(n_words + 1, counts.unknown, np.int64)
        if dictionary is not None:
            at, number = _unpacked(dictionary)
            ids[at] = number
        ids[-1] = counts.start
        names_, rank = np.unique(ids, return_inverse=True)  # local numbers along the global ones
        start, size = rank[-1], len(names_)
        unknown = np.searchsorted(names_, counts.unknown)
        unknown = unknown if unknown < size and names_[unknown] == counts.unknown else -1
        w = rank[_unpacked(tokens)[0]]
        firsts = np.cumsum(np.r_[0, lens])[:-1]
        v = np.r_[start, w[:-1]]
        v[firsts] = start
        u = np.r_[start, v[:-1]]
        u[firsts] = start
        doc = np.repeat(np.arange(len(lens)), lens)
        last = np.zeros(len(w), bool)
        last[firsts + lens - 1] = True

        base = np.log10(counts.base(names_))
        sent = (v != unknown) & (w != unknown)
        alone = ~sent
        local = np.log10(B * counts.unseen(names_[v[alone]], names_[w[alone]])) - np.where(last[alone], 0, empty)
        score = np.bincount(doc[alone], local, len(lens)) - math.log10(counts.documents + B)
        n = len(lens)
        figures = [lens, np.bincount(doc, w != unknown, n).astype(np.int64), np.bincount(doc, base[w], n), score]
        yield row(block % counts.slices(), block, _packed(*figures), True)

        v, w, u, doc = v[sent], w[sent], u[sent], doc[sent]
        pairs, of = np.unique(v * size + w, return_inverse=True)
        keys, of = np.unique(of * size + u, return_inverse=True)
        places, times = np.unique(of * n + doc, return_counts=True)
        pair_v, pair_w = names_[pairs // size], names_[pairs % size]
        key_pair, key_u = keys // size, names_[keys % size]
        place_key, place_doc = places // n, places % n
        slices = counts.slice_of(pair_v, pair_w)
        cuts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(slices) else []
        for p0, p1 in zip(cuts, [*cuts[1:], len(slices)]):
            k0, k1 = np.searchsorted(key_pair, [p0, p1])
            e0, e1 = np.searchsorted(place_key, [k0, k1])
            payload = _packed(
                np.diff(pair_v[p0:p1], prepend=0),
                np.diff(pair_w[p0:p1], prepend=0),
                np.bincount(key_pair[k0:k1] - p0, minlength=p1 - p0).astype(np.int32),
                key_u[k0:k1],
                np.bincount(place_key[e0:e1] - k0, minlength=k1 - k0).astype(np.int32),
                place_doc[e0:e1].astype(np.int32),
                times[e0:e1].astype(np.int32),
                trained.astype(np.uint8),
                ids[:1],  # the end, the first word of every block
            )
            yield row(int(slices[p0]), block, payload, False)

    slim = coded.select(
        "block", F.size("words").alias("n_words"), "tokens", F.col("docs.n").alias("lens"), F.col("docs.trained").alias("trained"), "dictionary"
    )
    return slim.mapInArrow(asked, ddl)


_ASKED = ["pair_v", "pair_w", "keys_of", "key_u", "places_of", "doc", "times", "trained", "end"]


def _asked(payload: bytes) -> dict[str, np.ndarray]:
    found = dict(zip(_ASKED, _unpacked(payload)))
    found["pair_v"], found["pair_w"] = np.cumsum(found["pair_v"]), np.cumsum(found["pair_w"])
    found["pair"] = np.repeat(np.arange(len(found["keys_of"])), found["keys_of"])
    found["key"] = np.repeat(np.arange(len(found["places_of"])), found["places_of"])
    return found


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of distinct trigrams of several lists of (v, w, u, count), sorted."""
    v, w, u, c = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((u, w, v))
    v, w, u, c = v[order], w[order], u[order], c[order]
    first = _runs(v, w, u)
    return v[first], w[first], u[first], _sums(c, first)


def _answers(rows: pa.Table, counts: Counts) -> pa.Table:
    """For each block one sum per document, over the trigrams of one slice, looked up in its trie."""
    own = rows.filter(rows.column("own"))
    rows = rows.filter(pc.invert(rows.column("own")))
    payloads = rows.column("payload")
    parts, held = [(np.zeros(0, np.int64),) * 4], 0
    for payload in payloads:
        x = _asked(payload.as_py())
        c = np.bincount(x["key"], x["times"] * x["trained"][x["doc"]], len(x["key_u"])).astype(np.int64)
        met = np.flatnonzero(c)
        pair = x["pair"][met]
        parts.append((x["pair_v"][pair], x["pair_w"][pair], x["key_u"][met], c[met]))
        held += len(met)
        if held > counts.slice_tokens:  # what is held grows with distinct trigrams alone
            parts = [_merged(parts)]
            held = len(parts[0][0]) // 2
    model = Weighted.build(*_merged(parts), counts)
    del parts
    sums = []
    for payload in payloads:
        x = _asked(payload.as_py())
        weight, after = model.weights(x["pair_v"], x["pair_w"], x["pair"], x["key_u"], counts)
        after[x["pair_w"] == x["end"]] = 0  # nothing follows the end
        sums.append(_packed(np.bincount(x["doc"], x["times"] * (weight - after[x["pair"]])[x["key"]], len(x["trained"]))))
    answered = pa.table({"block": rows.column("block"), "sums": pa.array(sums, pa.binary()), "own": pa.array([None] * len(sums), pa.binary())})
    handed = pa.table({"block": own.column("block"), "sums": pa.array([None] * len(own), pa.binary()), "own": own.column("payload")})
    return pa.concat_tables([answered, handed])


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of each block, whose rows follow each other."""
    names = ["block", "doc", "n_tokens", "n_known", "base_score", "score"]
    block, own, total = None, None, 0.0

    def closed() -> pa.RecordBatch:
        lens, known, base, score = _unpacked(own)
        columns = [np.full(len(lens), block), np.arange(len(lens), dtype=np.int32), lens, known, base.view(float), score.view(float) + total]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    for batch in batches:
        for b, sums, figures in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block:
                if block is not None:
                    yield closed()
                block, own, total = b, None, 0.0
            if sums is not None:
                total = total + _unpacked(sums)[0].view(float)
            own = figures or own
    if block is not None:
        yield closed()


# -- documents -----------------------------------------------------------------------


def scores(
    docs: DataFrame, trained: Column, doc_id: str = "doc_id", text: str = "text", *,
    block_tokens: int = BLOCK_TOKENS, slice_tokens: int = SLICE_TOKENS,
) -> DataFrame:
    """One row per document: ``doc_id``, the tokens, how many are trained words, all trained
    tokens, and the log10 probability of the text in the base and in the trigram model.

    ``trained`` says which documents the model learns from; null counts as false.
    """
    spark = bounded_batches(docs.sparkSession)
    # what is written needs the shuffle files behind it no more
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    read = written(blocks(docs, doc_id, text, trained, block_tokens), "blocks")
    known, counts = vocabulary(read, slice_tokens)
    numbers = written(dictionaries(read, known), "dictionaries")
    coded = read.join(numbers, "block", "left")
    answers = _trigrams(coded, counts).groupBy("slice").applyInArrow(
        lambda rows: _answers(rows, counts), "block long, sums binary, own binary"
    )
    figures = answers.repartition("block").sortWithinPartitions("block").mapInArrow(
        _figures, "block long, doc int, n_tokens long, n_known long, base_score double, score double"
    )
    ids = read.select("block", F.posexplode("docs.id").alias("doc", doc_id))
    return figures.join(ids, ["block", "doc"]).select(
        doc_id, "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
