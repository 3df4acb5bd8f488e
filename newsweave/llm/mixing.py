"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight, so that a sort of a
source by the keys is a weighted sample without replacement of any length.  A source takes
complete epochs first, then documents in the order of their keys until its budget of words
is used up.  Keys are hashes of the documents: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.llm.shared import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
QUALITY_WEIGHTS = {1: 1.5, 0: 0.5}
SEED = "mix"
# Documents of one source that are sorted in one task, about.
RUN_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_no, source_size, docs, target), one row per source, a null source included.

    Sources by code point, null last, have the weights in turn.  They divide ``share`` times
    all words by weight; no target exceeds ``most`` times the source's words, what is above
    goes to the others by weight.  The windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = by_source.withColumn("source_no", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    # Sources reach their limit in the order of words per weight.
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    earlier = F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    levelled = numbered.withColumn("weight", weight).withColumn("level", (total * F.lit(share) - earlier * F.lit(most)) / later)
    holds = F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(most)
    level = F.min_by(F.when(holds, F.col("level")), F.when(holds, F.struct(F.col("source_size") / F.col("weight"), "source_no"))).over(every)
    target = F.least(level * F.col("weight"), F.col("source_size") * F.lit(most))
    return levelled.select("source", "source_no", "source_size", "docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _place(key: Column, weight: Column) -> Column:
    """A document's place in [0, 1): 1 - exp(-x) of its exponential key x, so the order is that of the keys."""
    uniform = (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return 1 - F.pow(uniform, 1 / weight)


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of the rows: all that the decisions need."""
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("*", size.alias("__size"), key.alias("__key"))


def _placed(rows: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (.., doc_id, source, size, key) with their source's numbers and their place in it."""
    quality = F.create_map(*(F.lit(x) for pair in QUALITY_WEIGHTS.items() for x in pair))
    graded = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").alias("quality"))
        .select("label_id", F.coalesce(F.try_element_at(quality, F.col("quality")), F.lit(1.0)).alias("weight"))
    )
    by_source = targets.withColumnRenamed("source", "of_source")
    order = F.struct(_place(F.col("key"), F.coalesce("weight", F.lit(1.0))).alias("place"), "doc_id", "key")
    return (
        rows.join(graded, F.col("doc_id") == F.col("label_id"), "left")
        .join(by_source, F.col("source").eqNullSafe(F.col("of_source")))
        .select(*rows.columns, *[c for c in targets.columns if c != "source"], order.alias("order"))
    )


def _limits(sizes: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with where a source's fractional selection ends.

    ``last`` is the order of its last document and ``left`` the words that this document, or
    its equal rows together, still give; both are null where complete epochs are all.
    Words are added up by run of the order, then inside the one run in which a source ends.
    """
    total = targets.agg(F.sum("docs")).first()[0] or 0
    rows = _placed(sizes, labels, targets).withColumn("run", (F.col("order.place") * F.lit(total // RUN_ROWS + 1)).cast("long"))
    along = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        rows.groupBy("source_no", "run", "rest").agg(F.sum("size").alias("words"))
        .withColumn("run_start", F.coalesce(F.sum("words").over(along), F.lit(0)))
        .where("run_start < rest and rest <= run_start + words")
        .select("source_no", "run", "run_start")
    )
    inside = Window.partitionBy("source_no").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    started = (
        rows.select("source_no", "run", "rest", "size", "order").join(ends, ["source_no", "run"])
        .withColumn("before", F.col("run_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .where("before < rest")
        .groupBy("source_no", "order", "rest").agg(F.min("before").alias("start"))
    )
    last = started.groupBy("source_no").agg(
        F.max(F.struct("order", (F.col("rest") - F.col("start")).alias("left"))).alias("end")
    )
    return targets.join(last, "source_no", "left").select(*targets.columns, F.col("end.order").alias("last"), F.col("end.left").alias("left"))


def mixed(docs: DataFrame, labels: DataFrame, keep_all: bool = False) -> DataFrame:
    """(doc, size, source_size, target, taken), one row per row of docs.

    ``doc`` holds the row's doc_id or, with keep_all, all its columns, so that names can't
    clash.  ``size`` is the text's words (0 for null and empty texts), ``taken`` the words
    that the mix takes, repeats counted: a source's taken words add up to its target rounded
    down, and no document exceeds twice its size.  Labels weigh documents by quality
    (repeated labels by the lowest, none or null as 1).  Ties of keys go by doc_id and by a
    hash of id and text; equal rows give their words one after the other.  Empty tables give
    no rows.

    The decisions are made without the texts: where each source's selection ends follows
    from sums of runs along the keys and one run per source.  Rows then compare themselves
    with that end.
    """
    sized = _sized(docs).select(
        F.struct(*docs.columns if keep_all else ["doc_id"]).alias("doc"), "doc_id", "source",
        F.col("__size").alias("size"), F.col("__key").alias("key"),
    )
    light = written(sized.select("doc_id", "source", "size", "key"), "sizes")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    targets = source_targets(light.select("source", "size")).withColumn("epochs", epochs)
    targets = written(targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "targets")
    limits = written(_limits(light, labels, targets), "limits")

    rows = sized if keep_all else light.withColumn("doc", F.struct("doc_id"))
    placed = _placed(rows, labels, limits)
    at_end = F.coalesce(F.col("order") == F.col("last"), F.lit(False))
    whole = F.when(F.col("order") < F.col("last"), F.col("size")).otherwise(0)
    number = F.row_number().over(Window.partitionBy("source_no").orderBy("order"))
    share = F.greatest(F.least(F.col("left") - (number - 1) * F.col("size"), F.col("size")), F.lit(0))
    parts = [(placed.where(~at_end), whole), (placed.where(at_end), share)]
    out = [
        part.withColumn("some", some).select(
            "doc", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("some")).cast("long").alias("taken")
        )
        for part, some in parts
    ]
    return out[0].unionByName(out[1])


def mixture(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes words of, with ``taken`` beside their columns."""
    took = mixed(docs, labels, keep_all=True).where("taken > 0")
    return took.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c != "taken"), "taken")
