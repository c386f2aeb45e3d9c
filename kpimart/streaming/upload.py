"""File-arrival trigger (STR-1) with Structured Streaming.

The stream watches the folder's listing (path and modification time of every
``.csv.gz``), not the files' contents. A batch picks its upload from the
listing and opens only that upload's files, with the same by-name CSV reader
as a batch load; the rows are staged once and the entitled dashboards'
snapshots are replaced, so the newest upload wins and nothing accumulates.

An upload is one file, or with ``folders=True`` a folder of part files (moved
in with one rename, so that a batch sees all of it). By default each upload is
processed in the order of arrival; with ``latest_only=True`` a batch takes all
pending uploads and processes only the newest, since the older ones would be
superseded: a backlog of k uploads costs one computation and one parse.

The snapshot id is derived from the stream's name and ``batch_id``: a batch
that is replayed after a failure writes that snapshot anew. What became of an
upload is recorded in the store's upload log, and a replay skips what is
recorded. An upload that cannot be read (a missing column, a malformed row, a
torn archive) is recorded with its error and does not stop the stream: the
uploads after it are processed, and with ``latest_only`` the newest readable
one wins. Any other error stops the stream, whose restart replays the batch.
``clean_source`` removes the files a batch consumed, whether they succeeded or
failed; ``quarantine`` names a folder to which failed ones are moved instead.
An upload that is gone when its batch is replayed was consumed before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpimart.operators.entitlements import authorize
from kpimart.plans.families import fan_out_table
from kpimart.plans.fanout import fan_out, stage
from kpimart.session import scratch_dir
from kpimart.sinks.store import SnapshotStore, delete_path, move_path, path_exists
from kpimart.sources.csv import UPLOAD_GLOB, load_csv
from kpimart.streaming.log import UploadLog

LISTING = "path string, modificationTime timestamp, length long, content binary"


def entitled_dashboards(user_id: int, users: DataFrame, dashboards: DataFrame, access: DataFrame) -> DataFrame:
    """The dashboards that a user may recompute (ENT-4/ENT-6)."""
    requests = dashboards.select(F.lit(user_id).cast("bigint").alias("user_id"), "dashboard_id", F.lit("upload").alias("action"))
    allowed = authorize(requests, users, dashboards, access).where("allowed").select("dashboard_id")
    return dashboards.join(allowed, "dashboard_id", "left_semi")


def pending_uploads(listing: DataFrame, folders: bool) -> list[tuple[str, list[str]]]:
    """``(upload, files)`` of a batch's listing, oldest first."""
    name = F.regexp_replace("path", "/[^/]*$", "") if folders else F.col("path")
    uploads = listing.select(name.alias("upload"), "path", "modificationTime").groupBy("upload").agg(
        F.max("modificationTime").alias("arrived"), F.sort_array(F.collect_list("path")).alias("files")
    )
    return [(r.upload, list(r.files)) for r in uploads.orderBy("arrived", "upload").collect()]


#: Marks of errors that the contents of an upload cause.
BAD_UPLOAD = ("Failed to load CSV file", "FAILED_READ_FILE", "ZipException", "EOFException", "TextParsingException", "not a gzip file", "MALFORMED_CSV_RECORD")


def upload_error(exc: Exception) -> str | None:
    """The reason if an upload's own contents made reading it fail, else None
    (lost storage, missing files and other faults are not the upload's)."""
    if isinstance(exc, ValueError) and not isinstance(exc, PySparkException):
        return str(exc)
    text = str(exc)
    if "FILE_NOT_EXIST" in text:
        return None
    for mark in BAD_UPLOAD:
        if mark in text:
            return next(line for line in text.splitlines() if mark in line)[:2000]
    return None


def upload_stream(
    spark: SparkSession,
    input_dir: str,
    schema,
    configs: Mapping[int, object] | DataFrame,
    store: SnapshotStore,
    checkpoint_location: str,
    name: str = "uploads",
    clean_source: bool = False,
    available_now: bool = True,
    processing_time: str | None = None,
    latest_only: bool = False,
    folders: bool = False,
    uploader: tuple[int, DataFrame, DataFrame] | None = None,
    malformed: str = "null",
    quarantine: str | None = None,
) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes the uploads
    present and stops (call ``awaitTermination``). ``configs`` is a mapping of
    dashboard id to config, or the dashboards table ``(dashboard_id,
    config)`` itself, whose families are then planned inside Spark. With
    ``uploader`` (user id, users, access) only the dashboards of the table
    that this user may recompute are touched."""
    if uploader is not None and not isinstance(configs, DataFrame):
        raise ValueError("An uploader's entitlement needs the dashboards table")
    reader = (
        spark.readStream.format("binaryFile")
        .schema(LISTING)
        .option("pathGlobFilter", UPLOAD_GLOB)
        .option("recursiveFileLookup", "true")
    )
    if not latest_only and not folders:
        reader = reader.option("maxFilesPerTrigger", 1)
    # the content column is not selected, so no file is read here
    listing = reader.load(input_dir).select("path", "modificationTime")

    log = UploadLog(spark, store.root)

    def process(files: list[str], sid: str) -> str | None:
        """Replace the snapshots by an upload's; the reason if it is unreadable."""
        path = scratch_dir(spark, "staged")
        try:
            try:
                staged = stage(load_csv(spark, files, schema, multi_line=True, malformed=malformed), path)
            except Exception as exc:
                reason = upload_error(exc)
                if reason is None:
                    raise
                return reason
            if not isinstance(configs, DataFrame):
                fan_out(staged, configs, store, snapshot_id=sid, stage_input=False)
                return None
            boards = configs if uploader is None else entitled_dashboards(uploader[0], uploader[1], configs, uploader[2])
            fan_out_table(staged, boards, store, snapshot_id=sid, stage_input=False)
            return None
        finally:  # the snapshots are written: the staged copy is no longer read
            delete_path(spark, path)

    def consume(files: list[str], failed: bool) -> None:
        for f in files if clean_source else []:
            if failed and quarantine is not None:
                move_path(spark, f, f"{quarantine.rstrip('/')}/{'/'.join(f.split('/')[-2:] if folders else f.split('/')[-1:])}")
            else:
                delete_path(spark, f)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        uploads = pending_uploads(batch, folders)
        done = log.recorded(name, batch_id)
        won = False
        # oldest first; a backlog goes from the newest on until one is readable
        for i, (upload, files) in reversed(list(enumerate(uploads))) if latest_only else enumerate(uploads):
            failed = False
            if upload not in done and all(path_exists(spark, f) for f in files):
                sid = f"{name}-{batch_id:012d}" + (f"-{i:04d}" if len(uploads) > 1 and not latest_only else "")
                if won:
                    log.record(name, batch_id, upload, "superseded")
                else:
                    reason = process(files, sid)
                    failed = reason is not None
                    log.record(name, batch_id, upload, "failed" if failed else "ok", reason, None if failed else sid)
                    won = latest_only and not failed
            elif latest_only and upload in done:
                won = won or upload not in log.failed(name, batch_id)
            consume(files, failed)

    writer = listing.writeStream.queryName(name).foreachBatch(on_batch).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
