"""The registered queries of the operators: each applies one of them to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import (
    chat,
    cover_tree,
    decontaminate,
    language_model,
    mixing,
    order_minhash,
    pii,
    secret_scan,
    sql,
    toxicity,
    turn_trie,
    url_filter,
    warc,
    whitening,
)
from newsweave.llm.shared import table


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its links, its component, and whether it stands for the component."""
    return cover_tree.linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of near-duplicates, and whether it stands for the class."""
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its record, as read back from the bundles."""
    records = warc.read_bundles(warc.archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recovered turn of every conversation, written as a plain transcript."""
    transcripts = chat.as_transcripts(table(spark, sf_dir, "conversations"))
    return chat.parse(transcripts, chat.fit(transcripts)).drop("text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the secrets in it and in what it encodes."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(secret_scan.count_of("base", kind).alias(f"n_{kind}") for kind in secret_scan.KINDS),
        F.sha2(secret_scan.digest_text("base"), 256).alias("base_sha256"),
        secret_scan.digest_text("spans").alias("spans"),
        "unopened",
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the personal data in it."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS),
        F.sha2(pii.digest_text(*pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.digest_text(*pii.KINDS).alias("spans"),
    )


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: the parts of its url and the verdict on it."""
    judged = url_filter.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its source's target, and the words that the mix takes of it."""
    mixed = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how likely it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the words and items of the benchmark in it."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its log10 probability in a model of nine tenths of the documents."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    scored = language_model.scores(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per usable vector and component: its whitened value."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.component_rows(vectors, whitening.fit(vectors)).select(
        "row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_cover_tree": (op1_cover_tree, sql.VECTOR_LINKS),
    "op2_order_minhash": (op2_order_minhash, None),
    "op3_warc": (op3_warc, sql.WARC),
    "op4_transcripts": (op4_transcripts, None),
    "op5_secret_scan": (op5_secret_scan, None),
    "op6_personal_data": (op6_personal_data, sql.PERSONAL_DATA),
    "op7_url_rules": (op7_url_rules, None),
    "op8_mixing": (op8_mixing, sql.MIXING),
    "op9_toxicity": (op9_toxicity, None),
    "op10_winnowing": (op10_winnowing, sql.WINNOWING),
    "op11_prefix_trie": (op11_prefix_trie, sql.PREFIX_TRIE),
    "op12_language_model": (op12_language_model, None),
    "op13_whitening": (op13_whitening, None),
}
