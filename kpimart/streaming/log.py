"""Commit records of uploads: what became of each (STR-1, SNK-7).

One row per (stream, batch, upload), appended when the upload is done: ``ok``,
``failed`` with its error (a dead letter) or ``superseded``. A batch that is
replayed after a failure reads its records first, so that no upload is run, or
reported, twice. Records of a batch lie in a folder of their own, and each is
a folder in it: concurrent streams never share an output path.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimart.sinks.store import path_exists

RECORD = "stream string, batch_id long, upload string, status string, error string, snapshot_id string, recorded_at timestamp"


class UploadLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/_uploads"

    def _folder(self, stream: str, batch_id: int) -> str:
        return f"{self.path}/{stream}-{batch_id:012d}"

    def _read(self, path: str) -> DataFrame:
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(path)

    def recorded(self, stream: str, batch_id: int) -> set[str]:
        """The uploads of a batch that are done (a batch's own, few rows)."""
        return {r.upload for r in self._read(self._folder(stream, batch_id)).select("upload").collect()}

    def failed(self, stream: str, batch_id: int) -> set[str]:
        """The uploads of a batch that are recorded as failed."""
        rows = self._read(self._folder(stream, batch_id)).where("status = 'failed'")
        return {r.upload for r in rows.select("upload").collect()}

    def record(
        self, stream: str, batch_id: int, upload: str, status: str, error: str | None = None, snapshot_id: str | None = None
    ) -> None:
        now = _dt.datetime.now(_dt.timezone.utc)
        row = (stream, batch_id, upload, status, error, snapshot_id, now)
        path = f"{self._folder(stream, batch_id)}/{uuid.uuid4().hex}"
        self.spark.createDataFrame([row], RECORD).coalesce(1).write.parquet(path)

    def records(self) -> DataFrame:
        """All records, one per (stream, batch, upload): the earliest."""
        rows = self._read(self.path)
        first = F.min_by(F.struct(*rows.columns), "recorded_at")
        return rows.groupBy("stream", "batch_id", "upload").agg(first.alias("r")).select("r.*")

    def dead_letters(self) -> DataFrame:
        """The uploads that failed, with their errors."""
        return self.records().where("status = 'failed'")
