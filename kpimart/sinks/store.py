"""Per-dashboard aggregate snapshots (SNK-1..4, SCL-3, PIP-6).

Layout under ``root``::

    data/dashboard_id=<id>/snapshot_id=<sid>-<attempt>/part-*.parquet
    batches/<sid>-<attempt>/dashboard_id=<id>/part-*.parquet     (families)
    _manifest/entry-<uuid>/part-*.parquet   (dashboard_id, snapshot_id, created_at, row_count, path)

Each manifest entry is its own small folder, so concurrent saves of
different dashboards never share an output path (or a committer's
temporary folder); the manifest is read recursively.

Every attempt writes to a folder of its own and never replaces one. The
manifest rows are appended last and readers go by the manifest's paths, so a
reader sees a whole snapshot or the one before. Replaying a save with the
same ``snapshot_id`` (a retried stream batch) adds a newer row for it; the
manifest is read de-duplicated on ``(dashboard_id, snapshot_id)``, newest
first. An empty result is a real snapshot (Parquet keeps its schema),
distinct from "never saved" (no manifest row). Each dashboard keeps its own
schema. A save prunes the dashboard's superseded folders after its manifest
row has landed; the current and the previous snapshot are kept, so a reader
that looked up the manifest just before a save can still read.
``compact_manifest`` and ``vacuum`` are maintenance calls for a time without
readers and writers. One writer per dashboard is assumed.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("dashboard_id", T.LongType(), False),
        T.StructField("snapshot_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
    ]
)


@dataclass(frozen=True)
class SnapshotInfo:
    dashboard_id: int
    snapshot_id: str
    created_at: _dt.datetime
    row_count: int
    path: str


def _fs(spark: SparkSession, path: str):
    """Hadoop FileSystem for ``path`` (local, HDFS or object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def move_path(spark: SparkSession, path: str, to: str) -> bool:
    """Rename within a file system; the target's folder is made if missing."""
    fs, p = _fs(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    return bool(fs.rename(p, target))


def _norm(path: str) -> str:
    """Compare paths without scheme or trailing slash."""
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            path = path[len(prefix):]
            break
    return path.rstrip("/")


def new_snapshot_id(now: _dt.datetime | None = None) -> str:
    """Time-ordered id: sorts like ``created_at``, unique under ties."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/_manifest"

    def attempt_path(self, dashboard_id: int, snapshot_id: str) -> str:
        """A fresh folder for one attempt to save a dashboard's snapshot."""
        return f"{self.root}/data/dashboard_id={int(dashboard_id)}/snapshot_id={snapshot_id}-{uuid.uuid4().hex[:12]}"

    def batch_path(self, snapshot_id: str) -> str:
        """A fresh folder for one attempt to save a family of dashboards."""
        return f"{self.root}/batches/{snapshot_id}-{uuid.uuid4().hex[:12]}"

    def append_manifest(self, rows: DataFrame) -> DataFrame:
        """Append manifest rows as one entry; returns them as written."""
        path = self._entry_path()
        rows.select(*MANIFEST_SCHEMA.names).write.parquet(path)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(path)

    # SNK-3
    def ensure(self) -> "SnapshotStore":
        """Create an empty manifest if there is none (idempotent)."""
        if not path_exists(self.spark, self.manifest_path):
            empty = self.spark.createDataFrame([], MANIFEST_SCHEMA).coalesce(1)
            empty.write.parquet(self._entry_path("init"))
        return self

    def _entry_path(self, kind: str = "entry") -> str:
        return f"{self.manifest_path}/{kind}-{uuid.uuid4().hex}"

    # SNK-1, SCL-3, PIP-6
    def save(
        self,
        dashboard_id: int,
        df: DataFrame,
        snapshot_id: str | None = None,
        created_at: _dt.datetime | None = None,
        prune: bool = True,
        retain: int = 2,
    ) -> SnapshotInfo:
        """Replace the dashboard's aggregate with ``df``.

        ``created_at`` is stamped once on the driver, so it is stable under
        task retries. The row count is observed on the write itself (no
        second job)."""
        self.ensure()
        created_at = created_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        snapshot_id = snapshot_id or new_snapshot_id()
        path = self.attempt_path(dashboard_id, snapshot_id)
        obs = Observation(f"snapshot_{uuid.uuid4().hex}")
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        rows = int(obs.get["rows"])
        info = SnapshotInfo(int(dashboard_id), snapshot_id, created_at, rows, path)
        row = [(info.dashboard_id, info.snapshot_id, info.created_at, info.row_count, info.path)]
        self.append_manifest(self.spark.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1))
        if prune:
            self.prune(dashboard_id, retain=retain)
        return info

    def manifest(self) -> DataFrame:
        """All snapshots, one row per ``(dashboard_id, snapshot_id)``."""
        self.ensure()
        m = self.spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(self.manifest_path)
        latest_row = F.max_by(F.struct(*[c for c in m.columns]), F.col("created_at"))
        return m.groupBy("dashboard_id", "snapshot_id").agg(latest_row.alias("r")).select("r.*")

    def current(self) -> DataFrame:
        """The latest snapshot of every dashboard (one row each)."""
        m = self.manifest()
        pick = F.max_by(F.struct(*m.columns), F.struct("created_at", "snapshot_id"))
        return m.groupBy("dashboard_id").agg(pick.alias("r")).select("r.*")

    def latest_info(self, dashboard_id: int) -> SnapshotInfo | None:
        """Manifest lookup for one dashboard; reads one row to the driver."""
        row = self.current().where(F.col("dashboard_id") == F.lit(int(dashboard_id))).first()
        return None if row is None else SnapshotInfo(**row.asDict())

    # SNK-2
    def get(self, dashboard_id: int) -> DataFrame | None:
        """The dashboard's latest aggregate, or None if never saved."""
        info = self.latest_info(dashboard_id)
        return None if info is None else self.spark.read.parquet(info.path)

    def read_batch(self, snapshot_id: str) -> DataFrame | None:
        """The rows of the family members saved under one snapshot id, with
        their ``dashboard_id``; None if there are none. One scan per family
        folder (one per pipeline shape), found through the manifest; shapes
        with different columns are united by name. Other dashboards of the
        snapshot (shared or saved alone) are read with ``get``."""
        mine = self.manifest().where((F.col("snapshot_id") == F.lit(snapshot_id)) & (F.col("row_count") > 0))
        rows = mine.select("dashboard_id", F.regexp_extract("path", "^(.*)/dashboard_id=[^/]*$", 1).alias("family"))
        rows = rows.where(F.col("family").startswith(f"{self.root}/batches/"))
        out = None
        for r in rows.select("family").distinct().collect():
            ids = rows.where(F.col("family") == F.lit(r.family)).select("dashboard_id")
            data = self.spark.read.parquet(r.family).withColumn("dashboard_id", F.col("dashboard_id").cast("bigint"))
            data = data.join(ids, "dashboard_id", "left_semi")
            out = data if out is None else out.unionByName(data, allowMissingColumns=True)
        return out

    def folders_of(self, dashboards: DataFrame) -> DataFrame:
        """``dashboard_id, path`` of the current snapshots of the dashboards in
        a table ``(dashboard_id)``, those with rows: what reading them opens."""
        ids = dashboards.select(F.col("dashboard_id").cast("bigint").alias("dashboard_id")).distinct()
        return self.current().where("row_count > 0").join(ids, "dashboard_id", "left_semi").select("dashboard_id", "path")

    def read_many(self, dashboards: DataFrame) -> DataFrame | None:
        """The current snapshots of the dashboards in a table, with their
        ``dashboard_id``; None if there are none. Folders are read as one scan
        per schema, and only those the manifest names; a snapshot that several
        dashboards share is read once. Snapshots of different columns are
        united by name. The list of folders reaches the driver, as for any
        scan of many folders."""
        folders = self.folders_of(dashboards)
        paths = [r.path for r in folders.select("path").distinct().collect()]
        by_schema: dict[str, list[str]] = {}
        kinds = {}
        for schema, path in self._schemas(paths):
            by_schema.setdefault(schema.json(), []).append(path)
            kinds[schema.json()] = schema

        def plain(path: Column) -> Column:
            """Without scheme and authority."""
            return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", ""), "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")

        mine = folders.select("dashboard_id", plain(F.col("path")).alias("__folder"))
        out = None
        for kind, group in sorted(by_schema.items()):
            data = self.spark.read.schema(kinds[kind]).parquet(*sorted(group))
            folder = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/[^/]*$", "")
            data = data.select("*", plain(folder).alias("__folder")).join(mine, "__folder").drop("__folder")
            data = data.select("dashboard_id", *[c for c in kinds[kind].names if c != "dashboard_id"])
            out = data if out is None else out.unionByName(data, allowMissingColumns=True)
        return out

    def _schemas(self, paths: list[str]):
        """``(schema, path)`` of snapshot folders, by a footer of each; the
        folders of one family have one schema."""
        family = {p: p.rpartition("/dashboard_id=")[0] if p.startswith(f"{self.root}/batches/") and "/dashboard_id=" in p else p for p in paths}
        sample = {f: p for p, f in family.items()}
        with ThreadPoolExecutor(max_workers=8) as pool:
            known = dict(pool.map(lambda f: (f, self.spark.read.parquet(sample[f]).schema), sample))
        return [(known[f], p) for p, f in family.items()]

    # SNK-4
    def has_batches(self) -> bool:
        """Are there folders beyond one save's (its rows and its empty one)?"""
        fs, base = _fs(self.spark, f"{self.root}/batches")
        return bool(fs.exists(base)) and len(fs.listStatus(base)) > 2

    def prune_families(self, retain: int = 2) -> int:
        """Delete family folders that no retained snapshot uses. Uses are
        counted from the manifest: a folder goes with the save that supersedes
        the last dashboard on it. Only folders with manifest rows are looked
        at, so a save that is under way keeps its own. Returns the number."""
        family = F.regexp_extract("path", f"^({re.escape(self.root)}/batches/[^/]+)", 1)
        kept = self._retained(None, retain).select("path", F.lit(1).alias("used"))
        uses = self.manifest().select("path").join(kept, "path", "left").withColumn("family", family).where("family <> ''")
        unused = uses.groupBy("family").agg(F.count("used").alias("uses")).where("uses = 0")
        removed = 0
        for row in unused.select("family").toLocalIterator():
            removed += delete_path(self.spark, row.family)
        return removed

    def _retained(self, dashboard_id: int | None, retain: int) -> DataFrame:
        """Snapshots to keep: the newest ``retain`` per dashboard, by
        ``(created_at, snapshot_id)`` (the current one and, with retain=2, the
        previous one, which a reader may have looked up just before a save)."""
        m = self.manifest()
        if dashboard_id is not None:
            m = m.where(F.col("dashboard_id") == F.lit(int(dashboard_id)))
        w = Window.partitionBy("dashboard_id").orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc())
        return m.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= retain).select("path")

    def prune(self, dashboard_id: int, retain: int = 2) -> int:
        """Delete the dashboard's own snapshot folders beyond the newest
        ``retain`` (family batches are shared: ``prune_families``)."""
        fs, base = _fs(self.spark, f"{self.root}/data/dashboard_id={int(dashboard_id)}")
        if not fs.exists(base):
            return 0
        folders = [st for st in fs.listStatus(base) if st.isDirectory() and st.getPath().getName().startswith("snapshot_id=")]
        if len(folders) <= retain:
            return 0  # nothing to prune: no manifest job needed
        keep = {_norm(r.path) for r in self._retained(dashboard_id, retain).collect()}
        removed = 0
        for status in folders:
            p = status.getPath()
            if status.isDirectory() and p.getName().startswith("snapshot_id=") and _norm(p.toString()) not in keep:
                fs.delete(p, True)
                removed += 1
        return removed

    def vacuum(self, retain: int = 2, older_than: _dt.timedelta = _dt.timedelta(0)) -> int:
        """Delete data folders that no retained snapshot uses, left-overs of
        failed attempts included, once their files are older than
        ``older_than`` (give it the time that the longest write may take).
        Returns the number of folders."""
        tops = [t for t in (f"{self.root}/data", f"{self.root}/batches") if path_exists(self.spark, t)]
        if not tops:
            return 0
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tops)
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        folders = files.groupBy(plain(F.regexp_replace("path", "/[^/]*$", "")).alias("folder")).agg(
            F.max("modificationTime").alias("newest")
        )
        kept = self._retained(None, retain).select(plain(F.col("path")).alias("folder")).distinct()
        limit = _dt.datetime.now(_dt.timezone.utc) - older_than
        unused = folders.where(F.col("newest") <= F.lit(limit)).join(kept, "folder", "left_anti")
        removed = 0
        for row in unused.select("folder").toLocalIterator():
            removed += delete_path(self.spark, row.folder)
        return removed

    def compact_manifest(self, max_entries: int = 64) -> bool:
        """Rewrite the manifest as one entry if it has more than
        ``max_entries``. The new entry is written first and the old ones are
        deleted after; a reader that listed the old ones before may fail and
        can retry, so call this when nothing else runs."""
        fs, base = _fs(self.spark, self.manifest_path)
        if not fs.exists(base):
            return False
        entries = [s.getPath() for s in fs.listStatus(base) if s.isDirectory()]
        if len(entries) <= max_entries:
            return False
        # Only the listed entries are compacted and deleted; an entry that a
        # save adds meanwhile stays as it is.
        listed = self.spark.read.schema(MANIFEST_SCHEMA).parquet(*[p.toString() for p in entries])
        latest_row = F.max_by(F.struct(*listed.columns), F.col("created_at"))
        deduped = listed.groupBy("dashboard_id", "snapshot_id").agg(latest_row.alias("r")).select("r.*")
        deduped.hint("rebalance").write.parquet(self._entry_path("compact"))
        for p in entries:
            fs.delete(p, True)
        return True
