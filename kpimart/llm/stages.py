"""The stages of the corpus pipeline, each on the operator it is named for.

Each takes ``(spark, docs, sf_dir)``. All but the last return the columns of
``docs``, whatever these are; rows keep their id, text, language and source.
Columns of names that the operators use themselves are kept as they are, an
empty table gives an empty result, and null ids and texts are told below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimart.llm import decontaminate, jaccard_join, language_id, mixing
from kpimart.llm.queries import shard_rows, written
from kpimart.sources.tables import table

#: Names of an operator's own columns inside a stage.
OWN = "__stage_"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter (null and
    empty texts among them) go. Repeated rows are judged each."""
    model = language_id.language_model(docs)
    found = language_id.identify(docs, model, docs.columns, OWN)
    return found.filter(F.col(OWN + "lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id. Documents
    without words stay; so do those without an id whose group has none."""
    found = written(jaccard_join.jaccard_components(docs), "near-copies")
    gone = found.filter(
        (F.col("n_shingles") > 0) & F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    ).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    gone = written(gone.distinct(), "near-copies-gone")
    if gone.count() <= jaccard_join.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    kept = docs.join(gone, same, "left_anti")
    # rows that repeat an id and its text are one document
    again = written(
        found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_key").count().filter("count > 1"),
        "near-copies-repeated",
    ).select("doc_id")
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no phrase of the benchmark; null and empty texts
    hold none. Repeated rows are judged each."""
    found = decontaminate.find_benchmark_spans(docs, table(spark, sf_dir, "benchmark"), docs.columns, prefix=OWN)
    return found.filter(F.size(OWN + "spans") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once for every whole pass,
    and once more for a part of a pass, with the part as its chance (by hash)."""
    sized = written(mixing.size_documents(docs), "mix-sizes")
    taken = mixing.words_taken(mixing.plan_mix(sized)).filter("taken > 0")
    chance = F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = (F.col("taken") % F.col("size")) / F.col("size")
    copies = F.expr("taken div size") + F.when(chance < part, 1).otherwise(0)
    uses = taken.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("source_key").alias("__source")).agg(
        F.max(copies).cast("int").alias("__copies")
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & (F.xxhash64("text") == F.col("__key"))
        & (mixing.source_key(F.col("source")) == F.col("__source"))
    )
    rows = docs.join(uses.filter("__copies > 0"), same)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in shards."""
    return shard_rows(docs)
