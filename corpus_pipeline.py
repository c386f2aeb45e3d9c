"""A corpus pipeline of the training-data operators.

``STAGES`` lists (name, function); each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. ``run`` applies them to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpimart.llm import stages
from kpimart.llm.queries import written
from kpimart.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.keep_known_languages),
    ("ngram_jaccard", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("source_mixing", stages.mix_sources),
    ("slot_sharding", stages.shard),
]

#: No SQL: language models, hash shuffles and similarity links have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
