"""Run-wide settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    default_fetch_interval: int = 3600
    default_relevance_threshold: float = 6.5
    default_lookback_years: int = 2
    output_dir: str = "token_news"
    default_rss_feeds: tuple[str, ...] = field(default_factory=tuple)
