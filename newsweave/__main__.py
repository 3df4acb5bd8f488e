"""Command line: ``python -m newsweave refresh|registry|publication ...``."""

from __future__ import annotations

import argparse
import time

from .plans.runs import run_publication, run_refresh, run_registry
from .session import build_session
from .sources.registry_files import load_settings, read_registry


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="newsweave")
    top.add_argument("--as-of", type=int, default=int(time.time()), help="epoch seconds")
    commands = top.add_subparsers(dest="command", required=True)
    refresh = commands.add_parser("refresh", help="refresh the articles of all tokens")
    for name in ("settings", "search", "feeds", "snapshots", "published"):
        refresh.add_argument(f"--{name}", required=True)
    refresh.add_argument("--registry", help="registry table, instead of the settings' tokens")
    registry = commands.add_parser("registry", help="grow the token registry")
    for name in ("networks", "candidates", "metadata", "registry"):
        registry.add_argument(f"--{name}", required=True)
    pages = commands.add_parser("publication", help="publication dates of pages")
    for name in ("pages", "out"):
        pages.add_argument(f"--{name}", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    if a.command == "refresh":
        settings, tokens = load_settings(spark, a.settings)
        if a.registry:
            tokens = read_registry(spark, a.registry)
        report, _ = run_refresh(
            spark,
            settings,
            tokens,
            search_path=a.search,
            feeds_path=a.feeds,
            snapshots=a.snapshots,
            published=a.published,
            as_of=a.as_of,
        )
        report.show()
    elif a.command == "registry":
        report, failed = run_registry(
            spark,
            networks_path=a.networks,
            candidates_path=a.candidates,
            metadata_path=a.metadata,
            registry_root=a.registry,
            as_of=a.as_of,
        )
        report.show()
        failed.show(truncate=False)
    else:
        run_publication(spark, a.pages, a.out, a.as_of)


if __name__ == "__main__":
    main()
