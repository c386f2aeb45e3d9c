"""Streams that outlive bad uploads (STR-1, SNK-7)."""

import gzip
import os

import pytest

from kpimart.config import AggregationSpec, PipelineConfig
from kpimart.sinks.store import SnapshotStore
from kpimart.streaming import upload as upload_module
from kpimart.streaming.log import UploadLog
from kpimart.streaming.upload import upload_stream

DDL = "id int, category string"
CONFIG = {7: PipelineConfig(aggregations=(AggregationSpec("id", "count", "n"),), group_by=("category",))}


def land(folder, name, text, at):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.csv.gz"
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else gzip.compress(text.encode()))
    os.utime(path, (at, at))
    return path


def run(spark, base, **options):
    store = SnapshotStore(spark, f"{base}/store")
    q = upload_stream(spark, f"{base}/in", DDL, CONFIG, store, f"{base}/checkpoint", name="u", **options)
    q.awaitTermination()
    assert q.exception() is None
    return store, {r.upload.rpartition("/")[2]: r for r in UploadLog(spark, store.root).records().collect()}


def rows(store):
    return {r.category: r.n for r in store.get(7).collect()}


GOOD = "id,category\n1,a\n2,b\n"


BAD = {
    "column": "id,kind\n1,a\n",
    "empty": "",
    "twice": "id,id,category\n1,1,a\n",
    "torn": gzip.compress(GOOD.encode() * 500)[:-30],
    "other": b"not gzip",
}


@pytest.mark.parametrize("bad", BAD.values(), ids=BAD)
def test_a_bad_upload_does_not_stop_later_ones(spark, tmp_path, bad):
    land(tmp_path / "in", "u1", GOOD, 1000)
    land(tmp_path / "in", "u2", bad, 2000)
    land(tmp_path / "in", "u3", GOOD + "3,b\n", 3000)
    store, records = run(spark, tmp_path, clean_source=True)
    assert rows(store) == {"a": 1, "b": 2}
    assert {k: r.status for k, r in records.items()} == {"u1.csv.gz": "ok", "u2.csv.gz": "failed", "u3.csv.gz": "ok"}
    assert records["u2.csv.gz"].error and records["u2.csv.gz"].snapshot_id is None
    assert not [f for f in os.listdir(tmp_path / "in") if f.endswith(".gz")]
    assert [r.upload for r in UploadLog(spark, store.root).dead_letters().collect()] == [records["u2.csv.gz"].upload]


def test_malformed_rows_fail_their_upload_if_told_so(spark, tmp_path):
    land(tmp_path / "in", "u1", GOOD, 1000)
    land(tmp_path / "in", "u2", "id,category\nx,a\n", 2000)
    store, records = run(spark, tmp_path, malformed="fail", clean_source=True, quarantine=str(tmp_path / "bad"))
    assert rows(store) == {"a": 1, "b": 1}
    assert "malformed row" in records["u2.csv.gz"].error
    assert [f for f in os.listdir(tmp_path / "bad") if f.endswith(".gz")] == ["u2.csv.gz"]


def test_the_newest_readable_upload_of_a_backlog_wins(spark, tmp_path):
    land(tmp_path / "in", "u1", "id,category\n1,old\n", 1000)
    land(tmp_path / "in", "u2", GOOD, 2000)
    land(tmp_path / "in", "u3", "id\n1\n", 3000)
    store, records = run(spark, tmp_path, latest_only=True, clean_source=True)
    assert rows(store) == {"a": 1, "b": 1}
    assert {k: r.status for k, r in records.items()} == {"u1.csv.gz": "superseded", "u2.csv.gz": "ok", "u3.csv.gz": "failed"}


def test_a_replayed_batch_skips_what_is_recorded(spark, tmp_path, monkeypatch):
    for i in (1, 2):
        land(tmp_path / f"in/up{i}", "part", GOOD if i == 1 else GOOD + "3,b\n", 1000 * i)
    processed, real = [], upload_module.load_csv

    def load(spark, files, *args, **kwargs):
        processed.append(files[0])
        if len(processed) == 2:
            raise OSError("storage is away")  # not the upload's fault
        return real(spark, files, *args, **kwargs)

    monkeypatch.setattr(upload_module, "load_csv", load)
    with pytest.raises(Exception, match="storage is away"):
        run(spark, tmp_path, folders=True)
    store, records = run(spark, tmp_path, folders=True)
    assert [p.split("/")[-2] for p in processed] == ["up1", "up2", "up2"]
    assert rows(store) == {"a": 1, "b": 2} and {r.status for r in records.values()} == {"ok"} and len(records) == 2
