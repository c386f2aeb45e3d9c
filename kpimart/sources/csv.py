"""CSV sources and validation (SRC-1..5).

gzip is not splittable: one task reads one ``.csv.gz`` file whatever its
size, so a loaded upload should be repartitioned (or staged to Parquet, see
``kpimart.plans.fanout``) before heavy work. Plain ``.csv`` splits normally.

Quoting follows RFC 4180: a field may hold a quoted newline or a doubled
quote; a quoted empty string stays ``""`` while a blank cell is null.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The admission rule for uploads (suffix and size limit).
UPLOAD_GLOB = "*.csv.gz"
MAX_UPLOAD_BYTES = 104_857_600

# Reader/writer options shared by load and export (RFC 4180 quoting; the
# null marker is a character that does not occur in text, so "" stays "").
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": ""}


def _schema(schema: T.StructType | str | Mapping[str, str] | None) -> T.StructType | None:
    if schema is None or isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, Mapping):
        schema = ", ".join(f"`{k}` {v}" for k, v in schema.items())
    # DDL text -> StructType, resolved by Spark's own parser.
    return SparkSession.getActiveSession().createDataFrame([], schema).schema


def read_header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str] | None:
    """The first record of ``path`` as raw header cells (None if empty)."""
    raw = spark.read.options(**{**CSV_OPTIONS, "header": "false", "multiLine": str(multi_line).lower()}).csv(path)
    first = raw.first()
    return None if first is None else [("" if v is None else v) for v in first]


#: Lines of a file that are looked at first for its header.
HEADER_LINES = 16


def _header_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` in which every file, or split, is a task of its
    own, so that a task's first lines are a file's."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(HEADER_LINES))
    return own


def plain_path(uri: Column) -> Column:
    """A path of ``_metadata.file_path``, which is percent-encoded, as the file
    system spells it."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path for a reader, none of its characters taken as a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def file_headers(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, header)`` of every non-empty file: the cells of its first
    record. Only a file's first lines go to Python (a Python task that stops is
    sent the rest of its input all the same); files whose first record is
    longer are read again, in whole."""
    reader = _header_session(spark).read.option("recursiveFileLookup", "true")
    found = _first_records((reader.option("pathGlobFilter", glob) if glob else reader).text(paths), HEADER_LINES)
    longer = [r.path for r in found if not r.closed and r.lines == HEADER_LINES]
    if longer:
        again = reader.text([literal_path(p) for p in longer])
        found = [r for r in found if r.closed or r.lines < HEADER_LINES] + _first_records(again, None)
    # a row per file, as a listing has it
    return spark.createDataFrame([(r.path, r.header) for r in found], "path string, header array<string>")


def _first_records(text: DataFrame, n_lines: int | None) -> list:
    """``path, header, closed, lines`` by file, from its first ``n_lines``: the
    cells of its first record, whether its quotes are closed, and its lines."""
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.input_file_block_start().alias("start"), "value")
    if n_lines is not None:
        # the low bits count the rows of a task
        nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        lines = lines.withColumn("nth", nth).where(F.col("nth") < n_lines)
    lines = lines.select(plain_path(F.col("path")).alias("path"), "start", "value")

    def first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, record, quotes = None, [], 0
        for batch in batches:
            if batch.num_rows and batch.column(1)[0].as_py() > 0:
                return  # a later split of a file
            for path, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                record.append(line)
                quotes += line.count('"')
                if quotes % 2 == 0:  # no quoted line break is open
                    break
            if record and quotes % 2 == 0:
                break
        if path is not None:
            cells = next(csv.reader(io.StringIO("\n".join(record), newline=""), skipinitialspace=True), None) or [""]
            header = pa.array([[c.strip() for c in cells]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), header, pa.array([quotes % 2 == 0]), pa.array([len(record)])], ["path", "header", "closed", "lines"]
            )

    return lines.mapInArrow(first_record, "path string, header array<string>, closed boolean, lines long").collect()


def header_groups(headers: DataFrame) -> list[tuple[list[str], list[str]]]:
    """Distinct headers with the files that have them (a file listing, as
    Spark keeps one on the driver for any read)."""
    rows = headers.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return sorted(([list(r.header), list(r.paths)] for r in rows), key=lambda g: g[1][0])


WIDTH_ERROR = "__wrong_width"


def read_group(spark: SparkSession, header: list[str], paths: list[str], multi_line: bool, literal: bool = True) -> DataFrame:
    """Files of one header as string columns named by it, with the file's uri
    (``__uri``, for ``plain_path``) and whether a row has too few or too many cells
    (``__wrong_width``). ``literal``: the paths are of a listing, not patterns."""
    names = [f"_c{i}" for i in range(len(header))]
    fields = [T.StructField(n, T.StringType()) for n in (*names, "_corrupt")]
    # all cells are parsed (no column pruning): only then is the width of a row known
    raw = (
        spark.read.schema(T.StructType(fields))
        .options(**CSV_OPTIONS, multiLine=str(multi_line).lower(), mode="PERMISSIVE")
        .options(columnNameOfCorruptRecord="_corrupt", columnPruning="false")
        .csv([literal_path(p) for p in paths] if literal else paths)
    )
    return raw.select(
        *[F.col(n).alias(h) for n, h in zip(names, header)],
        F.col("_metadata.file_path").alias("__uri"),
        F.col("_corrupt").isNotNull().alias(WIDTH_ERROR),
    )


def may_be_number(c: Column) -> Column:
    """False for cells that no cast to a number takes, by their first
    character: a cast that fails costs an exception, a look at it little."""
    first = F.ascii(c)
    named = first.isin(*map(ord, "iInN")) & c.rlike(r"(?i)^(?:nan|inf(?:inity)?)[\x00-\x20]*$")
    return (first <= ord("9")) | (first > 127) | named


def _cast(f: T.StructField) -> Column:
    """A string column's cells as the field's type, null if they do not cast."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
        return F.when(may_be_number(c), c.try_cast(f.dataType))
    return c.try_cast(f.dataType)


def _bad_cell(f: T.StructField) -> Column:
    return F.col(f"`{f.name}`").isNotNull() & _cast(f).isNull()


def _typed(strings: DataFrame, st: T.StructType, malformed: str) -> DataFrame:
    """The schema's columns by name. Malformed rows: ``null`` keeps them with
    null cells, ``drop`` leaves them out, ``fail`` stops with an error."""
    check_columns(strings, [f.name for f in st.fields])
    bad = F.col(WIDTH_ERROR)
    for f in st.fields:
        bad = bad | _bad_cell(f)
    if malformed == "drop":
        strings = strings.where(~bad)
    columns = [_cast(f).alias(f.name) for f in st.fields]
    if malformed == "fail":
        message = F.concat(F.lit("Failed to load CSV file: malformed row in "), plain_path(F.col("__uri")))
        columns = [F.when(bad, F.raise_error(message).cast(f.dataType)).otherwise(c).alias(f.name) for f, c in zip(st.fields, columns)]
    return strings.select(*columns)


def load_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | Mapping[str, str] | None = None,
    multi_line: bool | None = None,
    malformed: str = "null",
) -> DataFrame:
    """SRC-1: read CSV files (gzip or plain, a file, a folder or a list of
    files) with a header row each.

    Columns are bound by header name, file by file: the files may order their
    columns differently and have extra ones. With a schema the columns are
    typed as given; ``malformed`` says what becomes of rows with the wrong
    number of cells or with cells that do not cast (``null``, ``drop`` or
    ``fail``; ``validate_files`` counts them). Without a schema, types are
    inferred; over files of several headers the result has every column, typed
    to hold all files' cells, and null where a file lacks it. Any failure is
    one ``ValueError("Failed to load CSV file: ...")``: a missing path, an
    unreadable or empty file, duplicate header names.
    """
    if malformed not in ("null", "drop", "fail"):
        raise ValueError(f"Unknown treatment of malformed rows: {malformed}")
    paths = [path] if isinstance(path, str) else list(path)
    gzipped = all(p.endswith(".gz") for p in paths)
    multi_line = gzipped if multi_line is None else multi_line
    single = len(paths) == 1 and paths[0].endswith((".gz", ".csv"))
    try:
        if single:
            header = read_header(spark, paths[0], multi_line)
            groups = [(header, paths)] if header else []
        else:
            groups = header_groups(file_headers(spark, paths))
    except (AnalysisException, Py4JJavaError, PySparkException) as exc:
        # the message without the JVM's stack
        told = [line for line in str(exc).splitlines() if line.strip() and not line.lstrip().startswith("at ")]
        raise ValueError(f"Failed to load CSV file: {' '.join(told[:2])}") from exc
    if not groups or any(all(h == "" for h in header) for header, _ in groups):
        raise ValueError(f"Failed to load CSV file: {path} is empty (no header)")
    for header, _ in groups:
        dups = sorted({h for h in header if header.count(h) > 1})
        if dups:
            raise ValueError(f"Failed to load CSV file: duplicate column names {dups}")
    st = _schema(schema)
    if st is None and len(groups) == 1:
        reader = spark.read.options(**CSV_OPTIONS, multiLine=str(multi_line).lower(), mode="PERMISSIVE")
        files = paths if single else [literal_path(p) for p in groups[0][1]]
        return reader.option("inferSchema", "true").csv(files)
    strings = [read_group(spark, header, files, multi_line, literal=not single) for header, files in groups]
    if st is not None:
        return reduce(DataFrame.unionByName, [_typed(df, st, malformed) for df in strings])
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), strings)
    return _typed(united, infer_types(united), malformed)


#: What inference tries, narrowest first; a column that fits none is a string.
INFERRED = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def infer_types(strings: DataFrame) -> T.StructType:
    """A type for each string column: the narrowest that holds every non-empty
    cell of every file (int, bigint, double; date, timestamp; boolean), else
    string. Whether cells fit is a conjunction, so files and tasks merge in
    any order: one aggregate over the rows, one row to the driver."""
    names = [c for c in strings.columns if c not in ("__uri", WIDTH_ERROR)]
    bits = {kind: 1 << i for i, kind in enumerate(INFERRED)}

    def fits(c: Column, kinds: tuple[str, ...]) -> Column:
        """The bits of the kinds that a cell casts to."""
        held = [F.when(c.try_cast(INFERRED[k]).isNotNull(), bits[k]).otherwise(0) for k in kinds]
        return reduce(lambda a, b: a.bitwiseOR(b), held)

    found = []
    for i, name in enumerate(names):
        c = F.col(f"`{name}`")
        day = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
        # not 0 and 1, t and f, yes and no
        truth = F.when(F.lower(F.trim(c)).isin("true", "false"), bits["boolean"]).otherwise(0)
        # a cell has the form of a truth value, a whole number, a day or a number
        kinds = (
            F.when(~may_be_number(c), F.when(F.ascii(c).isin(*map(ord, "tTfF")), truth).otherwise(0))
            .when(c.rlike(r"^\s*[+-]?\d+\s*$"), fits(c, ("int", "bigint", "double")))
            .when(c.rlike(day), fits(c, ("timestamp",)).bitwiseOR(F.when(c.rlike(day + r"\s*$"), fits(c, ("date",))).otherwise(0)))
            .otherwise(truth.bitwiseOR(fits(c, ("double",))))
        )
        found.append(F.bit_and(F.when(c.isNotNull(), kinds)).alias(f"{i}"))
    # null: no cells
    row = strings.agg(*found).first() if names else ()
    held = [next((k for k in INFERRED if (mask or 0) & bits[k]), None) for mask in row]
    return T.StructType([T.StructField(n, INFERRED[k] if k else T.StringType()) for n, k in zip(names, held)])


def check_columns(df: DataFrame, expected) -> bool:
    """SRC-3/SET-2: every expected column is present (extras pass)."""
    names = list(expected.keys()) if isinstance(expected, Mapping) else [
        f.name for f in expected.fields] if isinstance(expected, T.StructType) else list(expected)
    missing = [c for c in names if c not in set(df.columns)]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return True


def check_types(df: DataFrame, expected: T.StructType | str | Mapping[str, str]) -> bool:
    """SRC-4: each expected column has the expected type (schema only)."""
    st = _schema(expected)
    check_columns(df, st)
    actual = {f.name: f.dataType for f in df.schema.fields}
    for f in st.fields:
        if actual[f.name] != f.dataType:
            raise ValueError(
                f"Type mismatch for column {f.name}: expected {f.dataType.simpleString()}, "
                f"got {actual[f.name].simpleString()}"
            )
    return True


def list_files(spark: SparkSession, directory: str, glob: str = UPLOAD_GLOB) -> DataFrame:
    """Files matching ``glob`` with their sizes; the content column is pruned,
    so no file is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", F.col("length").alias("size"), "modificationTime")
    )


def admit_files(
    spark: SparkSession, directory: str, glob: str = UPLOAD_GLOB, max_bytes: int | None = None
) -> DataFrame:
    """SRC-2: ``(path, size, admitted, reason)`` for each candidate upload. A
    size limit (such as ``MAX_UPLOAD_BYTES``) is opt-in."""
    files = list_files(spark, directory, glob)
    too_big = F.lit(False) if max_bytes is None else F.col("size") > F.lit(max_bytes)
    return files.select(
        "path",
        "size",
        (~too_big).alias("admitted"),
        F.when(too_big, F.lit(f"File is larger than {max_bytes} bytes")).alias("reason"),
    )


def check_admitted(spark: SparkSession, path: str, max_bytes: int | None = None) -> None:
    """SRC-2 for one upload: its name must match ``*.csv.gz``, and its size the
    limit, if one is given."""
    if not path.endswith(UPLOAD_GLOB[1:]):
        raise ValueError(f"Only {UPLOAD_GLOB} files are accepted: {path}")
    if max_bytes is not None:
        refused = list_files(spark, path).where(F.col("size") > F.lit(max_bytes)).first()
        if refused is not None:
            raise ValueError(f"File is larger than {max_bytes} bytes: {path}")


def validate_files(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | str | Mapping[str, str],
    glob: str = UPLOAD_GLOB,
    multi_line: bool | None = None,
) -> DataFrame:
    """SRC-5: one row per file ``(path, is_valid, error, bad_rows)``, never raises.

    Errors: empty file, duplicate header names, missing columns; extra columns
    pass. ``bad_rows`` counts rows with too few or too many cells, or with a
    non-empty cell that does not cast to its column's type; columns are bound
    by the file's own header. Quoted newlines are parsed for gzip files (one
    task per file anyway); plain CSV stays splittable unless ``multi_line=True``.
    """
    multi_line = glob.endswith(".gz") if multi_line is None else multi_line
    st = _schema(schema)
    expected = [f.name for f in st.fields]
    files = list_files(spark, directory, glob).select("path")
    headers = file_headers(spark, directory, glob)
    bad = None
    for header, paths in header_groups(headers):
        if len(set(header)) < len(header) or not set(expected) <= set(header):
            continue  # reported by its header
        is_bad = F.col(WIDTH_ERROR)
        for f in st.fields:
            is_bad = is_bad | _bad_cell(f)
        counted = (
            read_group(spark, header, paths, multi_line)
            .select("__uri", is_bad.alias("bad"))
            .groupBy("__uri")
            .agg(F.sum(F.col("bad").cast("long")).alias("bad_rows"))
            .select(plain_path(F.col("__uri")).alias("path"), "bad_rows")
        )
        bad = counted if bad is None else bad.unionByName(counted)
    if bad is None:
        bad = files.limit(0).select("path", F.lit(0).cast("long").alias("bad_rows"))
    j = files.join(headers, "path", "left").join(bad, "path", "left")
    missing = F.array_except(F.array(*[F.lit(c) for c in expected]), F.col("header"))
    error = (
        F.when(F.col("header").isNull(), F.lit("Empty file"))
        .when(F.size(F.array_distinct("header")) < F.size("header"), F.lit("Duplicate column names"))
        .when(F.size(missing) > 0, F.concat(F.lit("Missing columns: "), F.array_join(missing, ", ")))
    )
    bad_rows = F.coalesce(F.col("bad_rows"), F.lit(0)).cast("long")
    return j.select(
        "path", (error.isNull() & (bad_rows == 0)).alias("is_valid"), error.alias("error"), bad_rows.alias("bad_rows")
    )


def write_csv_gz(df: DataFrame, path: str) -> None:
    """Write ``df`` as gzip CSV with a header (the upload format)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("compression", "gzip").csv(path)
