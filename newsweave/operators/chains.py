"""Chain names, ids and RPC endpoints.

Chain tables hold ``pos``, the place in their file: the first entry wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def with_chain_name(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Name of each row's ``chain_id``, null if unknown."""
    names = chains.groupBy("chain_id").agg(
        F.min_by("chain_name", "pos").alias("chain_name")
    )
    return rows.join(names, "chain_id", "left")


def with_chain_id(rows: DataFrame, chains: DataFrame, name: str = "chain_name") -> DataFrame:
    """Id of the first chain with each row's name, letter case aside; else null."""
    ids = chains.groupBy(F.lower("chain_name").alias("_name")).agg(
        F.min_by("chain_id", "pos").alias("chain_id")
    )
    return rows.join(ids, F.lower(name) == F.col("_name"), "left").drop("_name")


def rpc_table(rpcs: DataFrame) -> DataFrame:
    """``chain_id, urls`` of the first entry per chain; ``rpcs`` has ``pos``."""
    urls = F.transform(F.coalesce("rpc", F.array()), lambda r: r["url"])
    return (
        rpcs.select(F.col("chainId").alias("chain_id"), "pos", urls.alias("urls"))
        .groupBy("chain_id")
        .agg(F.min_by("urls", "pos").alias("urls"))
    )


def with_rpc_urls(rows: DataFrame, rpcs: DataFrame) -> DataFrame:
    """RPC URLs of each row's chain, an empty list if there are none."""
    return rows.join(rpc_table(rpcs), "chain_id", "left").withColumn(
        "urls", F.coalesce("urls", F.array().cast("array<string>"))
    )
