"""Small column helpers shared by the function modules."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Catalyst inlines a column wherever it is used, and code generation does not
    share work between array lambdas.  A one-element ``transform`` binds the
    value to a lambda variable, so costly text work is not repeated.
    """
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def literal_map(values: dict[str, int]) -> Column:
    """A text-to-number map; constant folding makes it a plain literal."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,int>")


def replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a costly value that later filters look at.

    Catalyst copies an expression into every filter it pushes below, so the value
    would be worked out twice; it does not push through a generator.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


SPREAD_ROWS = 4096


def join_spread(
    rows: DataFrame, few: DataFrame, on: list[str], by: list[str], *, like: DataFrame | None = None, merged: bool = False
) -> DataFrame:
    """Join of very many rows with a table that may have only a few keys.

    A handful of keys would mean a handful of tasks however many rows there are, as
    adaptive execution doesn't broadcast a side that leaves most partitions empty.  So a
    small table is copied until it has some 4,096 rows, and ``by`` deals the rows of a key
    out over its copies; a larger one is joined as it is.  How large it is, or ``like``
    which is about as large, is counted when the job runs.

    ``merged`` is for a ``few`` that an explode may have made far larger than Spark takes it
    for, as its estimates leave out how many rows come of one: neither side is broadcast.
    """
    counted = F.greatest(F.count(F.lit(1)), F.lit(1))
    copies = (few if like is None else like).agg(F.greatest(F.lit(1), F.floor(SPREAD_ROWS / counted)).cast("int")).scalar()
    copied = few.withColumn("_slot", F.explode(F.sequence(F.lit(0), copies - 1)))
    dealt = rows.withColumn("_slot", F.pmod(F.xxhash64(*by), copies).cast("int"))
    return dealt.join(copied.hint("merge") if merged else copied, [*on, "_slot"]).drop("_slot")
