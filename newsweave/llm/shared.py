"""What the operators share: reading tables, written intermediate tables, bitmaps of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.session import shared_folder

# Bits of a membership bitmap: 2 MB, however many keys are in it.
BITMAP_BITS = 24
# One Arrow batch holds at most this many bytes, so long texts stay within a worker's memory.
BATCH_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the bytes of an Arrow batch, not only its rows; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    Cuts the lineage, so work below is done once and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot(key: Column) -> Column:
    """The bitmap slot of a long key."""
    return key.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the slots of all keys, as bytes of 8 slots each.

    At most 512 rows of 4 KB reach the driver for any number of keys.  A key that isn't
    in the table may share a slot with one that is, never the other way round.
    """
    at = slot(F.col(column)) + 1  # buckets of Spark's bitmaps begin with 1
    rows = (
        keys.where(F.col(column).isNotNull())
        .groupBy(F.bitmap_bucket_number(at).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        start = (row["bucket"] - 1) * len(part)
        bits[start : start + len(part)] = part
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each uint64 key's slot is set."""
    at = keys & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
