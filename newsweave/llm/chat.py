"""Chat transcripts: a hidden Markov model recovers the roles before turns are rendered.

States are the first line and the further lines of a system, user or assistant turn.  A line
shows the kind of speaker marker that it begins with, its length and whether it asks.  The
model is counted from labelled transcripts.  Blocks are numbered along conversation, turn and
text, and conversations cut into segments of so many numbers: one pass
reduces each segment to a matrix of best scores from any state to any other, the matrices
of a conversation are chained, and a second pass runs Viterbi inside each segment between
the states that the chain fixed.  The path is the best of the whole conversation, and no
task holds more than a segment.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.numbering import numbered
from newsweave.llm.shared import bounded_batches, written

ROLES = ["system", "user", "assistant"]
# State 2r begins a turn of role r, state 2r + 1 continues it.
STATES = 2 * len(ROLES)
# Blocks of a segment, at most.
SEGMENT = 256
# Ranges of blocks are told apart by so many characters of their texts.
RANGE_CHARS = 256
# The model is counted from about this many segments.
FIT_SEGMENTS = 5_000

# Names that speakers go by.
SPEAKERS = {
    "system": ["system", "context", "instructions", "note"],
    "user": ["user", "human", "q", "question", "customer", "me"],
    "assistant": ["assistant", "ai", "a", "answer", "bot", "agent"],
}
_NAMES = {name: role for role, names in SPEAKERS.items() for name in names}
MARKER = re.compile(r"\s*(?:\*\*|\[|<\|?|#+ )?([A-Za-z]{1,12})(?:\*\*|\]|\|?>)?\s?(?::|>|(?<=\])|(?<=>))(?:\*\*)?\s*")
MARKERS = ["none", *ROLES, "other"]
LENGTHS = [0, 1, 60, 200, 600]
# Observations: a marker, a class of length, and whether the line asks.
SIZES = (len(MARKERS), len(LENGTHS), 2)
RENDERED = "<|im_start|>{role}\n{text}<|im_end|>"


def observe(line: str) -> tuple[int, int, int, int]:
    """Marker, length class, question, and where the text behind the marker begins."""
    m = MARKER.match(line)
    marker, start = 0, 0
    if m and (role := _NAMES.get(m[1].lower())):
        marker, start = MARKERS.index(role), m.end()
    elif m and m[0].rstrip().endswith(":") and m[1][0].isupper():
        marker = len(MARKERS) - 1
    rest = line[start:].strip()
    return marker, int(np.searchsorted(LENGTHS, len(rest), "right")) - 1, int(rest.endswith("?")), start


class Model:
    """Log probabilities of an HMM: first states, transitions, and each kind of observation."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, shows: list[np.ndarray]):
        # A turn is continued by its own role alone.
        moves = moves + 0.5
        for j in range(1, STATES, 2):
            moves[[i for i in range(STATES) if i not in (j, j - 1)], j] = 0
        first = first + 0.5
        first[1::2] = 0
        with np.errstate(divide="ignore"):
            self.first = np.log(first / first.sum())
            self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))
        self.shows = [np.log((s + 0.5) / (s + 0.5).sum(axis=1, keepdims=True)) for s in shows]

    def emissions(self, seen: np.ndarray) -> np.ndarray:
        return sum(s[:, seen[:, i]] for i, s in enumerate(self.shows)).T

    def through(self, seen: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state at the last of them."""
        best = np.full((STATES, STATES), -np.inf)
        np.fill_diagonal(best, 0.0)
        for shown in self.emissions(seen):
            best = (best[:, :, None] + self.moves[None]).max(axis=1) + shown
        return best

    def path(self, seen: np.ndarray, start: np.ndarray, last: int | None = None) -> list[int]:
        """The best states of the lines, from scores of the states before them (None: a beginning)."""
        back, score = [], None
        for shown in self.emissions(seen):
            if score is None and start is None:
                score = self.first + shown
                back.append(None)
                continue
            options = (start if score is None else score)[:, None] + self.moves
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + shown
        if score is None:
            return []
        states = [int(score.argmax()) if last is None else last]
        for choice in back[:0:-1]:
            states.append(int(choice[states[-1]]))
        return states[::-1]


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, from rows sorted by them."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _blocks(transcripts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Blocks with their conversation's key and segment, written; equal blocks are one.

    Segments are stretches of the numbers of all blocks, so none has more than SEGMENT
    blocks, however many of a conversation have one turn or none.
    """
    text = F.coalesce("text", F.lit(""))
    alone = F.col("conv_id").isNull()
    rows = transcripts.select("conv_id", "turn", text.alias("text"), *(extra or [])).distinct()
    keyed = rows.select(
        F.when(alone, F.concat(F.lit("-"), F.sha1(F.concat_ws(":", "turn", "text")))).otherwise(F.col("conv_id").cast("string")).alias("conv"),
        "conv_id", "turn", "text", *(extra or []),
    )
    ranges = ["conv", "turn", F.substring("text", 1, RANGE_CHARS)]
    placed = numbered(keyed, ["conv", "turn", "text", *(extra or [])], "place", "blocks", ranges)
    return placed.withColumn("segment", F.floor(F.col("place") / SEGMENT)).drop("place")


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "turn", "text")


def _seen(rows: list[dict]) -> np.ndarray:
    return np.array([observe(line)[:3] for row in rows for line in lines_of(row["text"])], np.int64)


def fit(transcripts: DataFrame) -> Model:
    """Count a model from transcripts with a column ``role``; rows with other roles are skipped over."""
    blocks = _blocks(transcripts, ["role"])
    segments = blocks.select("conv", "segment").distinct().count()
    low = blocks.groupBy(F.col("conv").alias("of")).agg(F.min("segment").alias("low"))
    every = -(-max(segments, 1) // FIT_SEGMENTS)
    sample = blocks.where(F.pmod(F.xxhash64("conv", "segment"), F.lit(every)) == 0)
    sample = sample.join(low, F.col("conv") == F.col("of")).select("conv", "segment", "turn", "text", "role", (F.col("segment") == F.col("low")).alias("begins"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, moves = np.zeros(STATES), np.zeros((STATES, STATES))
        shows = [np.zeros((STATES, n)) for n in SIZES]
        for (_, _, begins), held in _segments(batches, ["conv", "segment", "begins"]):
            before = None
            for row in held:
                if row["role"] not in ROLES:
                    before = None
                    continue
                role = ROLES.index(row["role"])
                for i, line in enumerate(lines_of(row["text"])):
                    state = 2 * role + (i > 0)
                    if before is not None:
                        moves[before, state] += 1
                    elif begins:
                        first[state] += 1
                    for table, value in zip(shows, observe(line), strict=False):
                        table[state, value] += 1
                    before = state
        flat = np.concatenate([first, moves.ravel(), *(s.ravel() for s in shows)])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "n"])

    counts = _dealt(sample).mapInArrow(rows, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(STATES + STATES * STATES + STATES * sum(SIZES))
    for row in counts:
        flat[row["at"]] = row["n"]
    parts = np.split(flat, np.cumsum([STATES, STATES * STATES, *(STATES * n for n in SIZES[:-1])]))
    return Model(parts[0], parts[1].reshape(STATES, STATES), [p.reshape(STATES, -1) for p in parts[2:]])


def _chain(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The state before and at the end of each segment, on the best path of its conversation."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), held in _segments(batches, ["conv"]):
            score, back = None, []
            for row in held:
                own = np.array(row["through"]).reshape(STATES, STATES)
                options = own if score is None else score[:, None] + own
                if score is None:
                    score = own[0]
                    back.append(None)
                else:
                    back.append(options.argmax(axis=0))
                    score = options.max(axis=0)
            ends = [int(score.argmax())]
            for choice in back[:0:-1]:
                ends.append(int(choice[ends[-1]]))
            ends = ends[::-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(held)), pa.array([r["segment"] for r in held]), pa.array([None, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())],
                ["conv", "segment", "entry", "exit"],
            )

    return rows


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, part, role, continues, text, rendered): the recovered turns.

    ``transcripts`` holds blocks of lines (conv_id, turn, text), in the order of turn inside a
    conversation.  Each block gives one row per turn or piece of a turn in it, numbered by
    part; ``continues`` marks a piece whose turn began in an earlier block.  ``rendered`` is
    the canonical turn, without its speaker marker.  Null and empty texts are one empty line.
    Blocks without a conv_id are each a conversation of their own; those without a turn
    come first; blocks with equal turns go by text; equal blocks are one.  conv_id and turn may
    have any type that sorts.  An empty table gives no rows.  Other columns aren't read.
    """
    spark = transcripts.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    blocks = _blocks(transcripts)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for (conv, segment, begins), held in _segments(batches, ["conv", "segment", "begins"]):
            seen = _seen(held)
            if begins:
                start = own.first + own.emissions(seen[:1])[0]
                rest = own.through(seen[1:])
                through = np.tile((start[:, None] + rest).max(axis=0), (STATES, 1))
            else:
                through = own.through(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv]), pa.array([segment]), pa.array([through.ravel().tolist()])], ["conv", "segment", "through"]
            )

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        head = next(batches, None)
        if head is None:
            return
        id_kind, turn_kind = (head.schema.field(c).type for c in ("conv_id", "turn"))
        for _, held in _segments(itertools.chain([head], batches), ["conv", "segment"]):
            entry, exit_ = held[0]["entry"], held[0]["exit"]
            start = None
            if entry is not None:
                start = np.full(STATES, -np.inf)
                start[entry] = 0.0
            states = iter(own.path(_seen(held), start, exit_))
            out = []
            for row in held:
                pieces: list[list] = []
                for line in lines_of(row["text"]):
                    state = next(states)
                    begins = state % 2 == 0
                    if begins or not pieces:
                        pieces.append([ROLES[state // 2], not begins, []])
                    pieces[-1][2].append(line[observe(line)[3] :] if begins else line)
                for part, (role, continues, lines) in enumerate(pieces):
                    text = "\n".join(lines)
                    out.append((row["conv_id"], row["turn"], part, role, continues, text, RENDERED.format(role=role, text=text)))
            columns = list(zip(*out, strict=True))
            kinds = [id_kind, turn_kind, pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["conv_id", "turn", "part", "role", "continues", "text", "rendered"],
            )

    types = dict(transcripts.dtypes)
    span = blocks.groupBy("conv").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    # Conversations of one segment need no chain.
    long = written(span.where("low < high").select(F.col("conv").alias("of"), "low"), "long-conversations")
    opened = blocks.join(long, F.col("conv") == F.col("of")).select("conv", "segment", (F.col("segment") == F.col("low")).alias("begins"), "conv_id", "turn", "text")
    through = _dealt(opened).mapInArrow(matrices, "conv string, segment long, through array<double>")
    ends = (
        through.repartition("conv")
        .sortWithinPartitions("conv", "segment")
        .mapInArrow(_chain(model), "conv string, segment long, entry int, exit int")
    )
    ends = written(ends, "segment-ends").withColumnsRenamed({"conv": "of", "segment": "at"})
    here = (F.col("conv") == F.col("of")) & (F.col("segment") == F.col("at"))
    placed = blocks.join(ends, here, "left").select("conv", "segment", "conv_id", "turn", "text", "entry", "exit")
    return _dealt(placed).mapInArrow(
        turns,
        f"conv_id {types['conv_id']}, turn {types['turn']}, part int, role string, continues boolean, text string, rendered string",
    )


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations as plain transcripts: role markers in one of several styles per conversation.

    One turn in eight has no marker, nor have turns with an unknown role, so that roles can't
    be read off.  The column role stays, for counting a model and for comparisons.
    """
    styles = [("{}: ", 0), ("{}: ", 1), ("**{}:** ", 0), ("[{}] ", 1), ("{}: ", 2), ("### {}: ", 3)]
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(styles)))
    name = F.lit(None).cast("string")
    for number, (form, which) in enumerate(styles):
        for role, names in SPEAKERS.items():
            marker = form.format(names[which].capitalize())
            name = F.when((style == number) & (F.col("role") == role), F.lit(marker)).otherwise(name)
    bare = F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "turn"), F.lit(8)) == 0
    text = F.concat(F.when(bare, F.lit("")).otherwise(F.coalesce(name, F.lit(""))), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))
