"""Settings and the token registry on disk."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TOKEN
from ..settings import Settings
from .commits import commit, exists, new_attempt, newest

REGISTRY = "registry"


def _parse(text: str):
    """JSON, or YAML where a reader for it is installed; None if it is neither."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        return None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


def load_settings(spark: SparkSession, path: str) -> tuple[Settings, DataFrame]:
    """Settings and the tokens listed beside them in one small file.

    A missing, malformed or non-mapping file gives the defaults and no tokens; a
    missing key gives that key's default; ``tokens`` that is no list counts as empty.
    """
    content = None
    if exists(spark, path):
        file = spark.read.text(path, wholetext=True).first()
        content = _parse(file.value) if file else None
    if not isinstance(content, dict):
        content = {}
    known = {f.name for f in fields(Settings)} & content.keys()
    values = {k: content[k] for k in known if content[k] is not None}
    if "default_rss_feeds" in values:
        values["default_rss_feeds"] = tuple(values["default_rss_feeds"])
    tokens = content.get("tokens")
    return Settings(**values), token_table(spark, tokens if isinstance(tokens, list) else [])


def read_listed_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The tokens of all JSON settings files under ``path``, read where they lie.

    A token without a threshold of its own has its file's.  A file that is malformed, or whose
    ``tokens`` is no list, has no tokens.
    """
    schema = f"default_relevance_threshold double, tokens array<{TOKEN.simpleString()}>"
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("s"))
    listed = files.select(F.col("s.default_relevance_threshold").alias("default"), F.explode("s.tokens").alias("t"))
    return listed.select("t.*", "default").withColumn(
        "relevance_threshold", F.coalesce("relevance_threshold", "default")
    ).drop("default")


def token_table(spark: SparkSession, tokens: list[dict]) -> DataFrame:
    """Token mappings as a registry table; keys that are absent become null."""
    rows = [json.dumps(t) for t in tokens]
    parsed = spark.createDataFrame([(r,) for r in rows], "value string").select(
        F.from_json("value", TOKEN).alias("t")
    )
    return parsed.select("t.*")


def default_feed_urls(spark: SparkSession, settings: Settings) -> DataFrame:
    """``url, feed`` of the feeds every token reads."""
    rows = [(url, i) for i, url in enumerate(settings.default_rss_feeds)]
    return spark.createDataFrame(rows, "url string, feed bigint")


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """The registry table: the newest one committed under ``root``, or an empty one."""
    done = newest(spark, root)
    if done is None:
        return spark.createDataFrame([], TOKEN)
    return spark.read.schema(TOKEN).option("mode", "PERMISSIVE").json(done.part(spark, REGISTRY))


def write_registry(registry: DataFrame, root: str, as_of: int, attempt: str | None = None) -> None:
    """The whole registry, written once per run beside the one it was read from, and committed."""
    attempt = attempt or new_attempt()
    registry.write.json(f"{root}/{attempt}/{REGISTRY}")
    commit(registry.sparkSession, root, attempt, as_of)
