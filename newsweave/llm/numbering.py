"""Dense numbers along a sort order, without bringing the rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.shared import written

ROW_BITS = 33


def numbered(df: DataFrame, by: list, name: str, purpose: str, ranges: list | None = None) -> DataFrame:
    """The rows with a long ``name``: 0, 1, 2, ... along the sort order ``by``.

    The rows are sorted by ranges and written; what reaches the driver is one row a
    partition, its number of rows.  Equal keys are numbered in any order, the same one
    whenever the result is read.  ``ranges`` are shorter keys with the same order, where ``by``
    has long texts, since a sample of them reaches the driver.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*(ranges or by)).sortWithinPartitions(*by)
    ranged = written(ranged.select(F.struct("*").alias("row"), place.alias("at")), purpose)
    part = F.shiftright("at", ROW_BITS)
    sizes = ranged.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for size in sizes:
        starts.append((size["part"], total))
        total += size["count"]
    offsets = df.sparkSession.createDataFrame(starts, "part long, start long")
    number = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return ranged.join(F.broadcast(offsets), part == F.col("part")).select("row.*", number.alias(name))
