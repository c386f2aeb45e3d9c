r"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing. A record of the archive is one line of Spark's text writer whose line
end is the two line breaks after a record, so that files are plain WARC/1.1,
committed like any other output and on any file system Spark knows. Of records
with equal payloads the one of the largest page_id is a response, and others
are revisits of it, without the payload.

Reading. Archives are split like any text, at a line break and the magic
``WARC/1.``; a payload may hold these too. Each task emits, for every place of its split where a
record may start, the place its length leads to, followed as far as the split
goes; places are relative, as a task does not know what lies before its split.
Spark then numbers the splits' bytes, and pointer jumping from the start of
every file keeps the places that the chain of records reaches. A second scan
walks each split from the place where the chain enters it: what starts there
is a record, and any other magic belongs to the record around it. Records
that go on in later splits are put together from their parts.

A chain must end at the end of its file; ``read_records`` fails otherwise, and
``chain_ends`` tells where.

Edge cases: a null html is an empty payload; null and repeated page_ids: the
rows of the largest id are each a response, a null id is smaller than all (a
group of null ids only is all responses); a null url gives no target; control
characters and blanks of a url are percent-encoded; an empty table gives an
empty archive and result; columns that the operator does not name are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpimart.llm.tasks import written

#: Fixed values of the format: the magic's common part, and line breaks.
MAGIC = "WARC/1."
BREAK = "\r\n"
END = BREAK + BREAK
SEPARATOR = BREAK + MAGIC
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE16, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_ID = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
#: Rows of the table of splits that may be broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 1 << 17


def payload_digest(payload: Column) -> Column:
    """SHA-1 of binary data in upper-case base 32 (40 bits at a time)."""
    digest = F.sha1(payload)
    parts = [
        F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0"), BASE16, BASE32) for i in range(4)
    ]
    return F.concat(*parts)


# ------------------------------------------------------------------- writing


def page_records(pages: DataFrame, min_revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """``record``: the WARC record of every page, without the breaks after it.
    Payloads of fewer than ``min_revisit_bytes`` are never revisits."""
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("bytes")
    ).withColumn("digest", payload_digest(F.col("html").cast("binary")))
    # only payloads that more than one page has can be revisited
    copies = (
        sized.filter(F.col("bytes") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept"))
        .filter("n > 1 and kept is not null")
        .select("digest", "kept")
    )
    rows = sized.join(written(copies, "warc-copies"), "digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))

    def line(name: str, value: Column) -> Column:
        """A header line; none if the value is null."""
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))

    def uri(page_id: Column) -> Column:
        return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))

    target = F.col("url")
    for code in [*range(33), 127]:
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(f"{MAGIC}1{BREAK}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.when(revisit, uri(F.col("kept")))),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(BREAK),
        http,
        F.when(revisit, "").otherwise(F.col("html")),
    )
    return rows.select(record.alias("record"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = DATE) -> None:
    """Write the pages as WARC files under a new folder, one for each task."""
    records = page_records(pages, min_revisit_bytes, date)
    records.write.mode("errorifexists").option("lineSep", END).text(path)


# ------------------------------------------------------------------- reading


def _steady(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` in which the splits of files depend on the
    files alone, not on how many executors there are: both scans must agree."""
    steady = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and steady.conf.isModifiable(key):
            steady.conf.set(key, value)
    steady.conf.set("spark.sql.files.minPartitionNum", "1")
    return steady


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two separators, in the order of the files. The first
    chunk of a file starts with the magic, all others behind it."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    )


def _header(value: Column) -> Column:
    """The header of a record that starts here (after the magic), else null."""
    head = F.substring_index(value, END, 1)
    return F.when((F.octet_length(head) < F.octet_length(value)) & head.rlike(r"^[01]\r\n"), head)


def field(header: Column, name: str) -> Column:
    """A named field of a header (the first, whatever its case), or null."""
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?=\r\n|$)", 1)
    return F.when(found != "", found)


def _length(header: Column) -> Column:
    """Bytes from a record's magic to the next one's, by its header."""
    content = field(header, "Content-Length").try_cast("long")
    return F.lit(len(MAGIC) + 2 * len(END)) + F.octet_length(header) + content


def _split_chains(batches):
    """For every possible record start of a split: the last start that its
    chain reaches in the split, and the place it leads to. A row for the split
    itself has its bytes."""
    key, at, first, starts, ends = None, 0, False, [], []

    def told():
        place = {s: i for i, s in enumerate(starts)}
        last, leave = list(starts), list(ends)
        for i in range(len(starts) - 1, -1, -1):
            j = place.get(ends[i])
            if j is not None and j > i:
                last[i], leave[i] = last[j], leave[j]
        n = len(starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * (n + 1), pa.string()),
                pa.array([key[1]] * (n + 1), pa.int64()),
                pa.array([*starts, None], pa.int64()),
                pa.array([*last, None], pa.int64()),
                pa.array([*leave, None], pa.int64()),
                pa.array([None] * n + [at], pa.int64()),
            ],
            ["file", "split", "start", "last", "leave", "bytes"],
        )

    for batch in batches:
        for file, split, size, length, first_length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, split) != key:
                if key is not None:
                    yield told()
                key, at, first, starts, ends = (file, split), 0, split == 0, [], []
            start, length = (0, first_length) if first else (at - len(MAGIC), length)
            if length is not None:
                starts.append(start)
                ends.append(start + length)
            first = False
            at += size + len(SEPARATOR)
    if key is not None:
        yield told()


class Chains:
    """The chain of records of every file of an archive."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = _steady(spark)
        self.path = path
        value = F.col("value")
        first = F.when(value.startswith(MAGIC), F.substr(value, F.lit(len(MAGIC) + 1)))
        sized = (
            _chunks(self.spark, path)
            .select("file", "split", F.octet_length(value).cast("long").alias("size"), _header(value).alias("header"), _header(first).alias("first"))
            .select("file", "split", "size", _length(F.col("header")).alias("length"), _length(F.col("first")).alias("first_length"))
        )
        kinds = "file string, split long, start long, last long, leave long, bytes long"
        told = written(sized.mapInArrow(_split_chains, kinds), "warc-chains")
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        bases = told.filter("bytes is not null").select(
            "file", "split", "bytes", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")
        )
        self.splits = written(bases, "warc-splits")
        starts = told.filter("start is not null").drop("bytes").join(self.splits.select("file", "split", "base"), ["file", "split"])
        absolute = starts.select("file", "split", *((F.col(c) + F.col("base")).alias(c) for c in ("start", "last", "leave")))
        self.starts = written(absolute, "warc-starts")
        self.entries = self._entries()

    def _entries(self) -> DataFrame:
        """Where the chain from a file's start enters its splits."""
        # tables of possible starts grow with the records: never broadcast
        reached = written(self.starts.filter("start = 0").select("file", "start"), "warc-reached")
        targets = self.starts.select("file", F.col("start").alias("leave")).hint("merge")
        jumps = written(self.starts.select("file", "start", "leave").join(targets, ["file", "leave"], "left_semi"), "warc-jumps")
        while True:
            new = written(reached.join(jumps.hint("merge"), ["file", "start"]).select("file", F.col("leave").alias("start")), "warc-reached")
            if new.isEmpty():
                break
            reached = written(reached.unionByName(new), "warc-reached")
            on = jumps.select("file", F.col("start").alias("leave"), F.col("leave").alias("further"))
            jumps = written(jumps.join(on.hint("merge"), ["file", "leave"]).select("file", "start", F.col("further").alias("leave")), "warc-jumps")
        return written(self.starts.join(reached, ["file", "start"], "left_semi"), "warc-entries")

    def ends(self) -> DataFrame:
        """``file, bytes, chain_end``: a sound file's chain ends with it."""
        sizes = self.splits.groupBy("file").agg((F.max(F.col("base") + F.col("bytes")) - len(SEPARATOR)).alias("bytes"))
        ends = self.entries.groupBy("file").agg(F.max("leave").alias("chain_end"))
        return sizes.join(ends, "file", "left").select("file", "bytes", F.coalesce("chain_end", F.lit(0)).alias("chain_end"))

    def walks(self) -> DataFrame:
        """For every split: its ``base``, the record that starts first in it
        (``entry``) and the one that goes on into it (``open``, to ``until``)."""
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        entered = self.splits.join(self.entries.withColumnRenamed("start", "entry"), ["file", "split"], "left")
        return entered.select(
            "file",
            "split",
            "base",
            "entry",
            F.last("last", ignorenulls=True).over(earlier).alias("open"),
            F.last("leave", ignorenulls=True).over(earlier).alias("until"),
        )


def _split_records(batches):
    """The records of the splits: whole ones, and parts of those that go on in
    or come from another split. A record is given from behind its magic to the
    end of its content."""
    magic, separator, end_of_head = MAGIC.encode(), SEPARATOR.encode(), END.encode()
    key, at, first, entry, rows = None, 0, False, None, []
    record, upto, parts, opened = None, None, [], None  # the open record, its end, its bytes here and their place

    def close():
        if record is None or not parts:
            return
        data, need = b"".join(parts), upto - len(end_of_head) - opened
        rows.append((key[0], record, opened, opened == record + len(magic) and len(data) >= need, data[: max(0, need)]))

    def told():
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        names = ["file", "offset", "at", "whole", "data"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            file, split, value, base, enters, goes_on, until = (c[i].as_py() for c in batch.columns)
            if (file, split) != key:
                close()
                if base is None:
                    raise RuntimeError(f"The splits of {file} changed while it was read")
                key, at, first, entry = (file, split), base, split == 0, enters
                record, upto, parts, opened = goes_on, until, [], None
            start = 0 if first else at - len(magic)
            if start == entry:
                close()
                body = value[len(magic) :] if first else value
                head = body.index(end_of_head)
                record, parts, opened = start, [body], start + len(magic)
                upto = entry = opened + head + 2 * len(end_of_head) + _content_length(body[:head])
            elif record is not None and start < upto and not first:
                if not parts:  # it comes from an earlier split
                    opened = at - len(separator)
                parts += (separator, value)
            first = False
            at += len(value) + len(separator)
        if rows:
            yield told()
            rows.clear()
    close()
    yield told()


def _content_length(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value)
    raise ValueError("A record without Content-Length")


def chain_ends(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, chain_end`` of every file of an archive."""
    return Chains(spark, path).ends()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, header, block`` of every record of an archive (a folder
    or a file), the header without its first line. Fails if a file's chain of
    records does not end with the file."""
    chains = Chains(spark, path)
    broken = chains.ends().filter("bytes > 0 and chain_end <> bytes").take(5)
    if broken:
        places = ", ".join(f"{r.file} at {r.chain_end} of {r.bytes}" for r in broken)
        raise ValueError(f"Records end before their file does: {places}")
    walks = written(chains.walks(), "warc-walks")
    chunks = _chunks(chains.spark, path).select(F.col("value").cast("binary").alias("value"), "file", "split")
    if walks.count() <= BROADCAST_SPLITS:
        walked = chunks.join(F.broadcast(walks), ["file", "split"], "left")  # keeps the order
    else:
        placed = chunks.withColumn("nth", F.monotonically_increasing_id())
        walked = placed.join(walks, ["file", "split"], "left").repartition("file", "split").sortWithinPartitions("file", "split", "nth")
    walked = walked.select("file", "split", "value", "base", "entry", "open", "until")
    parts = walked.mapInArrow(_split_records, "file string, offset long, at long, whole boolean, data binary")
    found = parts.filter("whole").select("file", "offset", "data")
    if not walks.filter(f"open is not null and until > base - {len(MAGIC)}").isEmpty():
        torn = parts.filter("not whole").groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))
        found = found.unionByName(torn.select("file", "offset", F.expr("aggregate(parts, x'', (a, p) -> a || p.data)").alias("data")))
    header = F.substring_index(F.col("data").cast("string"), END, 1)
    return found.withColumn("header", header).select(
        "file",
        "offset",
        F.expr("substr(header, 4)").alias("header"),
        F.expr(f"substr(data, octet_length(header) + {len(END) + 1})").alias("block"),
    )


def page_index(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to,
    target_uri, verified`` of the records of an archive of pages. A response's
    bytes and digest are taken from its payload as read (``verified``: its
    header agrees), a revisit's from its headers."""
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    header = F.col("header")

    def page(name: str) -> Column:
        return F.regexp_extract(field(header, name), rf"^<{RECORD_ID}(-?\d+)>$", 1)

    rows = records.withColumn("http", http).withColumn("type", field(header, "WARC-Type"))
    payload = F.expr(f"substr(block, octet_length(http) + {len(END) + 1})")
    rows = rows.withColumn("payload", payload)
    said_bytes = field(F.col("http"), "Content-Length").cast("long")
    said = F.regexp_replace(field(header, "WARC-Payload-Digest"), "^sha1:", "")
    response = F.col("type") == "response"
    rows = rows.withColumn("digest", F.when(response, payload_digest(F.col("payload"))).otherwise(said))
    return rows.select(
        _number(page("WARC-Record-ID")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(said_bytes).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        _number(page("WARC-Refers-To")).alias("refers_to"),
        field(header, "WARC-Target-URI").alias("target_uri"),
        ((F.col("digest") == said) & (F.when(response, F.octet_length("payload")).otherwise(said_bytes) == said_bytes)).alias("verified"),
    )


def _number(text: Column) -> Column:
    """A whole number, or null for an empty or missing text."""
    return F.when(text != "", text).cast("long")


def archive_index(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages under ``path`` and index the archive as read back."""
    write_archive(pages, path, min_revisit_bytes)
    return page_index(read_records(pages.sparkSession, path))
