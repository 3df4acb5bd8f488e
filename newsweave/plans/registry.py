"""Registry refresh: candidates in, upserted registry out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.registry import (
    drop_native,
    look_up,
    new_candidates,
    registry_report,
    token_rows,
    with_chain_ids,
)


@dataclass(frozen=True)
class RegistryRefresh:
    registry: DataFrame
    new_tokens: DataFrame
    failed: DataFrame
    report: DataFrame


def look_up_candidates(
    networks: DataFrame,
    candidates: DataFrame,
    metadata: DataFrame,
    registry: DataFrame,
    *,
    order: str | None = None,
) -> DataFrame:
    """Every candidate that is new, with the metadata found for it.

    The cheap filters run before the lookup.
    """
    listed = drop_native(with_chain_ids(candidates, networks))
    return look_up(new_candidates(listed, registry, order=order), metadata)


def with_lookups(registry: DataFrame, lookups: DataFrame) -> RegistryRefresh:
    """The registry grown by the candidates that were found.

    It is written once, not once per token; ``failed`` lists the others.
    """
    new_tokens = token_rows(lookups)
    upserted = registry.unionByName(new_tokens)
    return RegistryRefresh(
        registry=upserted,
        new_tokens=new_tokens,
        failed=lookups.filter("found is null").drop("found"),
        report=registry_report(upserted, new_tokens),
    )


def refresh_registry(
    networks: DataFrame,
    candidates: DataFrame,
    metadata: DataFrame,
    registry: DataFrame,
    *,
    order: str | None = None,
) -> RegistryRefresh:
    """Add every candidate that is new and has metadata."""
    return with_lookups(
        registry, look_up_candidates(networks, candidates, metadata, registry, order=order)
    )
