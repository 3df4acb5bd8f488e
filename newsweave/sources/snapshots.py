"""Snapshot tables: one committed attempt per refresh, the newest one read back.

A refresh reads the newest committed snapshot and writes another one; overwriting the
folder being read would destroy the input of the running job.  See ``commits`` for the
layout.  The state lies in buckets of the hash of token and article key, as many as the
session has shuffle partitions, however many tokens there are: a token with a third of all
rows is spread like any other, and two snapshots are compared bucket by bucket.  Beside it
lies one row per token, with what reports and windows need of it.  Public files have a layout of their own,
``<root>/snapshot=<as_of>/token_key=<key>/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.articles import published
from ..schemas import ARTICLE_KEYS, PUBLISHED_FIELDS, SNAPSHOT
from .commits import Commit, commit, exists, names, new_attempt, newest, read_buckets, write_buckets, write_part

FINISHED = "_SUCCESS"
STATE, MARKS = "state", "marks"
# What a row of the state is known by.
ROW_KEY = "row_key"
STATE_SCHEMA = StructType([*SNAPSHOT.fields, StructField(ROW_KEY, StringType())])
TOTALS = StructType([StructField("token_key", StringType()), StructField("high_water", LongType()), StructField("kept", LongType())])
SNAPSHOT_PUBLIC = StructType(
    [SNAPSHOT[name] for name in PUBLISHED_FIELDS] + [StructField("token_key", StringType())]
)


def newest_finished(spark: SparkSession, root: str) -> str | None:
    """Path of the newest public folder that was written to the end."""
    found = [
        int(name.split("=", 1)[1])
        for name in names(spark, root)
        if name.startswith("snapshot=") and exists(spark, f"{root}/{name}/{FINISHED}")
    ]
    return f"{root}/snapshot={max(found)}" if found else None


def snapshot_time(spark: SparkSession, root: str) -> int | None:
    """When the newest snapshot was taken; None before the first."""
    done = newest(spark, root)
    return done.time if done else None


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The previous state, an empty table on the first run."""
    return read_state(spark, newest(spark, root)).select(*SNAPSHOT.fieldNames())


def read_state(spark: SparkSession, done: Commit | None) -> DataFrame:
    """The state of a commit with the key of its buckets, an empty table for none."""
    if done is None:
        return spark.createDataFrame([], STATE_SCHEMA)
    return read_buckets(done, spark, STATE, STATE_SCHEMA, ROW_KEY)


def read_totals(spark: SparkSession, done: Commit | None) -> DataFrame:
    """``token_key, high_water, kept`` of a commit: the newest article and the number of them."""
    if done is None:
        return spark.createDataFrame([], TOTALS)
    return spark.read.schema(TOTALS).parquet(done.part(spark, MARKS))


def row_key() -> Column:
    """128 bits that tell rows of the state apart by token and article key; nulls are values of their own."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in ("token_key", *ARTICLE_KEYS)]
    return F.md5(F.concat(*parts))


def new_in_state(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of a state whose token and key another one does not hold, bucket by bucket.

    Takes what ``write_state`` and ``read_state`` give.  No row moves where both have the same
    number of buckets.
    """
    return current.join(previous.select(ROW_KEY), ROW_KEY, "left_anti").select(*SNAPSHOT.fieldNames())


def totals_report(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``refresh_report`` from the totals of two snapshots, one row per token each."""
    zero = F.lit(0).cast("bigint")
    before = previous.select("token_key", F.col("kept").alias("previous"))
    joined = current.select("token_key", "kept").join(before, "token_key", "full")
    counts = joined.select("token_key", F.coalesce("kept", zero).alias("kept"), F.coalesce("previous", zero).alias("previous"))
    return counts.withColumn("added", F.col("kept") - F.col("previous"))


def ordered(state: DataFrame) -> DataFrame:
    """State in list order per token, ``position`` increasing with it.

    A range sort keeps a large token spread over many partitions, and row ids grow
    along the ranges, so no token is numbered in one task.
    """
    by = ["token_key", F.desc("timestamp"), "first_arrival"]
    return (
        state.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("position", F.monotonically_increasing_id())
        .withColumn("pinned", F.coalesce("pinned", F.lit(False)))
        .select(*SNAPSHOT.fieldNames())
    )


def write_state(state: DataFrame, root: str, attempt: str) -> DataFrame:
    """The ordered state and its totals per token as parts of an attempt; the state read back."""
    spark = state.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = ordered(state).withColumn(ROW_KEY, row_key())
    current = write_buckets(keyed, root, attempt, STATE, ROW_KEY, buckets)
    newest_of = F.max(F.coalesce("timestamp", F.lit(0))).alias("high_water")
    write_part(current.groupBy("token_key").agg(newest_of, F.count(F.lit(1)).alias("kept")), root, attempt, MARKS)
    return current


def write_snapshot(state: DataFrame, root: str, as_of: int) -> None:
    """Write and commit a state that takes no landings."""
    attempt = new_attempt()
    write_state(state, root, attempt)
    commit(state.sparkSession, root, attempt, as_of)


def write_published(snapshot: DataFrame, root: str, as_of: int, tokens: DataFrame) -> str:
    """Public JSON lines, one folder per token of ``tokens``, newest article first.

    A folder per run, whole when it is finished.  Only a run that died before it was
    committed has the time of another one, and what it left is replaced.  A token without articles has an empty list, a file with one blank line.
    """
    path = f"{root}/snapshot={as_of}"
    line = F.to_json(F.struct(*PUBLISHED_FIELDS))
    articles = published(snapshot, "token_key", "position").select("token_key", "position", line.alias("value"))
    nobody = (
        tokens.select("token_key").distinct().join(snapshot.select("token_key"), "token_key", "left_anti")
        .select("token_key", F.lit(0).cast("bigint").alias("position"), F.lit("").alias("value"))
    )
    by = ["token_key", "position"]
    rows = articles.unionByName(nobody).repartitionByRange(*by).sortWithinPartitions(*by)
    rows.drop("position").write.partitionBy("token_key").mode("overwrite").text(path)
    return path


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The public articles of the newest finished run."""
    path = newest_finished(spark, root)
    schema = SNAPSHOT_PUBLIC
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).json(path)


def append_items(items: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines folder."""
    items.write.mode("append").json(path)
