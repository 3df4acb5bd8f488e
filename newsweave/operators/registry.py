"""Growing the token registry from candidate tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import NATIVE_ADDRESS
from ..schemas import TOKEN

ADDRESS_PATTERN = "^0x[0-9a-fA-F]{40}$"
NEW_TOKEN_PHRASES = ["defi"]
NEW_TOKEN_LOOKBACK_YEARS = 2


def with_chain_ids(candidates: DataFrame, networks: DataFrame) -> DataFrame:
    """Tag candidates (``network, address, symbol``) with their network's chain id."""
    return candidates.join(networks.select("network", "chain_id"), "network")


def drop_native(candidates: DataFrame) -> DataFrame:
    """Leave out the placeholder of a chain's native coin, in any letter case."""
    return candidates.filter(F.lower("address") != NATIVE_ADDRESS.lower())


def registry_addresses(registry: DataFrame) -> DataFrame:
    """``network, address_key``: every address the registry holds, lower case."""
    return registry.select(F.explode("address").alias("network", "a")).select(
        "network", F.lower("a").alias("address_key")
    )


def new_candidates(
    candidates: DataFrame, registry: DataFrame, *, order: str | None = None
) -> DataFrame:
    """Candidates whose network and address the registry does not hold yet.

    A candidate that comes twice is taken once, its first row by ``order``, then by
    address and symbol.
    """
    keyed = candidates.withColumn("address_key", F.lower("address"))
    fresh = keyed.join(
        registry_addresses(registry), ["network", "address_key"], "left_anti"
    )
    rest = [c for c in candidates.columns if c != "network"]
    rank = F.struct(*([F.col(order)] if order else []), F.col("address"), *map(F.col, rest))
    return (
        fresh.groupBy("network", "address_key")
        .agg(F.min_by(F.struct(*rest), rank).alias("first"))
        .select("network", "first.*")
    )


def _metadata_key() -> list[Column]:
    return [F.col("chain_id"), F.lower("address").alias("address_key")]


def look_up(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Candidates with ``found``: name and symbol by chain id and address, null if none.

    Malformed addresses are never looked up.
    """
    known = metadata.groupBy(*_metadata_key()).agg(F.min(F.struct("name", "symbol")).alias("found"))
    lookup = F.when(F.col("address").rlike(ADDRESS_PATTERN), F.lower("address"))
    return (
        candidates.withColumn("address_key", lookup)
        .join(known, ["chain_id", "address_key"], "left")
        .drop("address_key")
    )


def token_rows(lookups: DataFrame) -> DataFrame:
    """Registry rows of the candidates that were found, every null typed.

    The contract's symbol replaces the listed one.
    """
    found = lookups.filter("found is not null")
    values = {
        "name": F.col("found.name"),
        "symbol": F.col("found.symbol"),
        "address": F.create_map("network", "address"),
        "lookback_years": F.lit(NEW_TOKEN_LOOKBACK_YEARS),
        "relevance_threshold": F.lit(None),
        "mandatory_phrases": F.array(),
        "additional_phrases": F.array(*map(F.lit, NEW_TOKEN_PHRASES)),
        "rss_feeds": F.lit(None),
    }
    return found.select(
        *(values[f.name].cast(f.dataType).alias(f.name) for f in TOKEN)
    )


def registry_report(registry: DataFrame, new_tokens: DataFrame) -> DataFrame:
    """``network, total_tokens, new_tokens``; the row without a network is the whole.

    A token on several networks counts in each of them, and once in the whole.
    """

    def counts(tokens: DataFrame, name: str) -> DataFrame:
        per_network = (
            tokens.select(F.explode(F.map_keys("address")).alias("network"))
            .groupBy("network")
            .agg(F.count(F.lit(1)).alias(name))
        )
        whole = tokens.agg(F.count(F.lit(1)).alias(name)).select(
            F.lit(None).cast("string").alias("network"), name
        )
        return per_network.unionByName(whole)

    new = counts(new_tokens, "new_tokens").withColumnRenamed("network", "_network")
    return (
        counts(registry, "total_tokens")
        .join(new, F.col("network").eqNullSafe(F.col("_network")), "left")
        .select(
            "network",
            "total_tokens",
            F.coalesce("new_tokens", F.lit(0).cast("bigint")).alias("new_tokens"),
        )
    )
