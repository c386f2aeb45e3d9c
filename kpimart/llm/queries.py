"""The queries of the training-data operators, and their SQL where it exists.

Each query reads its whole table and returns its operator's full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimart.llm import (
    decontaminate,
    html_extract,
    jaccard_join,
    language_id,
    lexical_search,
    mixing,
    pii,
    prefix_trie,
    quality,
    secret_scan,
    sharding,
    spotsigs,
    warc,
)
from kpimart.llm.oracles import ORACLE_SQL
from kpimart.llm.tasks import written
from kpimart.session import scratch_dir
from kpimart.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24


def shard_rows(docs: DataFrame) -> DataFrame:
    """``docs`` in 24 shards of nearly equal bytes, by 4,096 virtual slots."""
    placed = sharding.shard_by_slots(docs, SHARDS, scratch_dir(docs.sparkSession, "slot-map"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op1_slot_sharding(spark: SparkSession, d: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, by 4,096 virtual slots."""
    return shard_rows(table(spark, d, "documents"))


def op2_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents whose 5-word shingles reach a Jaccard of 0.75."""
    found = jaccard_join.jaccard_components(table(spark, d, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, d, "documents")
    found = language_id.identify(docs, language_id.language_model(docs), ["doc_id"])
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_html_extract(spark: SparkSession, d: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, d, "pages")
    return html_extract.extract_pages(pages, written(html_extract.wrappers(pages), "wrappers"), ["page_id", "url"])


def op5_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every secret candidate of every document, with the forest's verdict.
    Values are given by their SHA-256 only."""
    found = secret_scan.scan(table(spark, d, "documents"))
    return found.select(
        "doc_id",
        "start",
        "end",
        F.sha2("value", 256).alias("value_sha256"),
        secret_scan.held_out(F.col("doc_id")).alias("held_out"),
        "probability",
        "secret",
    )


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality of every document, learned from the labels not held out."""
    docs = table(spark, d, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, d, "labels")), ["doc_id"])
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, d, "documents")
    return pii.scan(docs, pii.train(docs), ["doc_id"])


def op8_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    """The words that a mix of all documents takes of each."""
    sized = written(mixing.size_documents(table(spark, d, "documents")), "mix-sizes")
    mix = mixing.plan_mix(sized)
    targets = mix.sources.select("source_key", F.col("source_size").alias("source_size"), "target")
    return (
        mixing.words_taken(mix)
        .join(targets, "source_key")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def op9_spotsigs(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return spotsigs.fingerprints(table(spark, d, "documents"))


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontaminate.find_benchmark_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return decontaminate.digest(found)


def op11_warc(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a record of a WARC archive, as read back."""
    found = warc.archive_index(table(spark, d, "pages"), scratch_dir(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, d, "conversations"))


def op13_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_slot_sharding,
        op2_ngram_jaccard,
        op3_language_id,
        op4_html_extract,
        op5_secret_scan,
        op6_quality,
        op7_pii,
        op8_source_mixing,
        op9_spotsigs,
        op10_decontamination,
        op11_warc,
        op12_prefix_trie,
        op13_lexical_search,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
