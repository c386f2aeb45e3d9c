"""SRC-1..5: CSV loading, admission and per-file validation."""

import gzip

import pytest

from kpimart.sources.csv import admit_files, check_columns, check_types, load_csv, validate_files

SCHEMA = "a string, n int"


def _write(path, text, gz=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    if gz:
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_plain_and_gz_give_equal_frames(spark, tmp_path):
    text = "a,n\nx,1\ny,2\n"
    plain = load_csv(spark, _write(tmp_path / "p" / "t.csv", text), SCHEMA)
    gz = load_csv(spark, _write(tmp_path / "g" / "t.csv.gz", text, gz=True), SCHEMA)
    assert sorted(plain.collect()) == sorted(gz.collect())
    assert plain.schema == gz.schema


def test_inferred_types(spark, tmp_path):
    df = load_csv(spark, _write(tmp_path / "t.csv.gz", "a,n,v\nx,1,1.5\n", gz=True))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "int", "double"]


def test_errors_are_descriptive(spark, tmp_path):
    with pytest.raises(ValueError, match="Failed to load CSV file"):
        load_csv(spark, str(tmp_path / "absent.csv.gz"))
    with pytest.raises(ValueError, match="empty"):
        load_csv(spark, _write(tmp_path / "e" / "empty.csv", ""))
    with pytest.raises(ValueError, match="duplicate column names"):
        load_csv(spark, _write(tmp_path / "d" / "dup.csv", "a,a\n1,2\n"))


def test_quotes_newlines_and_empty_strings(spark, tmp_path):
    text = 'a,b,c\n"line1\nline2","",\n'
    df = load_csv(spark, _write(tmp_path / "q.csv.gz", text, gz=True), "a string, b string, c string")
    r = df.collect()
    assert len(r) == 1
    assert r[0].a == "line1\nline2" and r[0].b == "" and r[0].c is None


def test_extra_column_passes_missing_column_fails(spark, tmp_path):
    extra = load_csv(spark, _write(tmp_path / "x" / "extra.csv", "a,n,z\nx,1,q\n"), SCHEMA)
    assert extra.columns == ["a", "n"]
    with pytest.raises(ValueError, match="Missing columns"):
        load_csv(spark, _write(tmp_path / "m" / "missing.csv", "a\nx\n"), SCHEMA)


def test_column_and_type_checks(spark, tmp_path):
    df = load_csv(spark, _write(tmp_path / "t.csv.gz", "a,n\nx,1\n", gz=True))
    assert check_columns(df, {"a": "string"})
    assert check_types(df, "a string, n int")
    with pytest.raises(ValueError, match="Type mismatch for column n: expected bigint, got int"):
        check_types(df, "n bigint")


def test_admission_by_suffix_and_size(spark, tmp_path):
    d = tmp_path / "up"
    _write(d / "small.csv.gz", "a,n\nx,1\n", gz=True)
    _write(d / "ignored.csv", "a,n\nx,1\n")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in admit_files(spark, str(d), max_bytes=1000).collect()}
    assert set(rows) == {"small.csv.gz"} and rows["small.csv.gz"].admitted
    tiny = admit_files(spark, str(d), max_bytes=10).first()
    assert not tiny.admitted and "larger" in tiny.reason


def test_validate_files_per_file(spark, tmp_path):
    d = tmp_path / "batch"
    _write(d / "good.csv.gz", "a,n\nx,1\ny,2\n", gz=True)
    _write(d / "bad_type.csv.gz", "a,n\nx,bad\ny,3\nz,oops\n", gz=True)
    _write(d / "missing.csv.gz", "a,m\nx,1\n", gz=True)
    _write(d / "dup.csv.gz", "a,a\nx,1\n", gz=True)
    _write(d / "empty.csv.gz", "", gz=True)
    res = {r.path.rsplit("/", 1)[-1]: r for r in validate_files(spark, str(d), SCHEMA).collect()}
    assert res["good.csv.gz"].is_valid and res["good.csv.gz"].bad_rows == 0
    assert not res["bad_type.csv.gz"].is_valid and res["bad_type.csv.gz"].bad_rows == 2
    assert res["missing.csv.gz"].error == "Missing columns: n"
    assert res["dup.csv.gz"].error == "Duplicate column names"
    assert res["empty.csv.gz"].error == "Empty file"


def test_header_only_file_is_an_empty_frame_that_validates(spark, tmp_path):
    df = load_csv(spark, _write(tmp_path / "h" / "header.csv.gz", "a,n\n", gz=True), SCHEMA)
    assert df.count() == 0 and df.columns == ["a", "n"]
    assert check_columns(df, ["a", "n"])


def test_validate_quoted_header_names(spark, tmp_path):
    d = tmp_path / "quoted"
    _write(d / "q.csv.gz", '"a","n","x, y"\nv,1,z\n', gz=True)
    _write(d / "m.csv.gz", '"a, n",b\nv,1\n', gz=True)
    res = {r.path.rsplit("/", 1)[-1]: r for r in validate_files(spark, str(d), SCHEMA).collect()}
    assert res["q.csv.gz"].is_valid, res["q.csv.gz"]
    assert res["m.csv.gz"].error == "Missing columns: a, n"


def test_validate_plain_csv_folder(spark, tmp_path):
    d = tmp_path / "plain"
    _write(d / "ok.csv", "a,n\nx,1\n")
    _write(d / "bad.csv", "a,n\nx,zz\n")
    res = {r.path.rsplit("/", 1)[-1]: r for r in validate_files(spark, str(d), SCHEMA, glob="*.csv").collect()}
    assert res["ok.csv"].is_valid and res["bad.csv"].bad_rows == 1


def test_files_of_one_folder_are_bound_by_their_own_headers(spark, tmp_path):
    _write(tmp_path / "f" / "a.csv.gz", "n,a\n1,x\n", gz=True)
    _write(tmp_path / "f" / "b.csv.gz", "extra,a,n\nq,y,2\n", gz=True)
    df = load_csv(spark, str(tmp_path / "f"), "a string, n int", multi_line=True)
    assert sorted((r.a, r.n) for r in df.collect()) == [("x", 1), ("y", 2)]
    report = {r.path.rsplit("/", 1)[-1]: r for r in validate_files(spark, str(tmp_path / "f"), "a string, n int").collect()}
    assert all(r.is_valid and r.bad_rows == 0 for r in report.values())


def test_malformed_rows_are_counted_kept_dropped_or_fatal(spark, tmp_path):
    path = _write(tmp_path / "m" / "m.csv.gz", "a,n\nx,1,extra\ny,oops\nz\nok,4\n", gz=True)
    report = validate_files(spark, str(tmp_path / "m"), "a string, n int").first()
    assert not report.is_valid and report.bad_rows == 3
    load = lambda how: load_csv(spark, path, "a string, n int", malformed=how)
    assert load("null").count() == 4
    assert [(r.a, r.n) for r in load("drop").collect()] == [("ok", 4)]
    with pytest.raises(Exception, match="malformed row"):
        load("fail").collect()


# ------------------------------------------- headers, folder names, inference


def _file(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    data = text.encode()
    (folder / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)


@pytest.mark.parametrize("suffix", ["csv", "csv.gz"])
def test_folders_of_any_name(spark, tmp_path, suffix):
    for i, name in enumerate(["a b", "50% off", "x+y", "[z]{1}", "é*?"]):
        _file(tmp_path / name, f"p.{suffix}", f"id,v\n{i},{name}\n")
    _file(tmp_path / "other order", f"p.{suffix}", "v,id\nlast,9\n")
    rows = {(r.id, r.v) for r in load_csv(spark, str(tmp_path), "id int, v string").collect()}
    assert rows == {(0, "a b"), (1, "50% off"), (2, "x+y"), (3, "[z]{1}"), (4, "é*?"), (9, "last")}
    found = validate_files(spark, str(tmp_path), "id int, v string", glob=f"*.{suffix}").collect()
    assert len(found) == 6 and all(r.is_valid for r in found)


def test_headers_are_first_records(spark, tmp_path):
    from kpimart.sources.csv import file_headers

    _file(tmp_path, "a.csv.gz", '"x, ""y""","two\n\nlines", z \n1,2,3\n')
    _file(tmp_path, "b.csv.gz", "x\n" * 5000)
    _file(tmp_path, "c.csv.gz", "")
    _file(tmp_path, "d.csv.gz", '"never closed\n1\n')
    got = {r.path.rpartition("/")[2]: r.header for r in file_headers(spark, str(tmp_path), "*.csv.gz").collect()}
    assert got["a.csv.gz"] == ['x, "y"', "two\n\nlines", "z"] and got["b.csv.gz"] == ["x"]
    assert "c.csv.gz" not in got and len(got["d.csv.gz"]) == 1


def test_inference_merges_files(spark, tmp_path):
    _file(tmp_path, "a.csv", "n,d,b,s\n1,2024-01-02,true,x\n-2,2024-1-3,FALSE,\n")
    _file(tmp_path, "b.csv", "s,n,extra,d,t,none\n7,2.5,5000000000,2024-01-02,2024-01-02 03:04:05,\n")
    df = load_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {
        "n": "double", "d": "date", "b": "boolean", "s": "string", "extra": "bigint", "t": "timestamp", "none": "string",
    }
    assert sorted((r.n, r.s, r.extra) for r in df.collect()) == [(-2.0, None, None), (1.0, "x", None), (2.5, "7", 5000000000)]


def test_unreadable_files_are_the_one_error(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"id\n" + b"1\n" * 9000)[:-20])
    with pytest.raises(ValueError, match="Failed to load CSV file"):
        load_csv(spark, [str(tmp_path / "a.csv.gz")], "id int").count()


def test_a_header_task_is_sent_a_files_first_lines(spark, tmp_path):
    from kpimart.sources.csv import HEADER_LINES, _first_records, file_headers

    name = "\n".join(f"line {i}" for i in range(3 * HEADER_LINES))
    _file(tmp_path, "long.csv.gz", f'"{name}",b\n1,2\n' * 50)
    _file(tmp_path, "open.csv.gz", '"open\n' + "1\n" * 500)
    _file(tmp_path, "short.csv", "a,b\n" + "1,2\n" * 500)
    (first,) = _first_records(spark.read.text(str(tmp_path / "open.csv.gz")), HEADER_LINES)
    assert first.lines == HEADER_LINES and not first.closed
    got = {r.path.rpartition("/")[2]: r.header for r in file_headers(spark, str(tmp_path)).collect()}
    assert got["long.csv.gz"] == [name, "b"] and got["short.csv"] == ["a", "b"] and len(got["open.csv.gz"]) == 1


def test_cells_of_no_numbers_form_are_not_cast(spark):
    from pyspark.sql import functions as F

    from kpimart.sources.csv import may_be_number

    bodies = "1 1. .5 1.5 1e5 1E-5 1.f 2d 0x1p3 0x.8P-1F NaN nan inf Infinity INF infinity \u0661\u0662 \u0661.5 oops Brand#1 NATION_3 infinite".split()
    cells = [f"{a}{s}{b}{z}" for s in ("", "+", "-") for b in bodies for a, z in (("", ""), (" ", "\n"), ("\t", " "), ("\x01", "\x02"))]
    c = F.col("c")
    tried = F.coalesce(*[c.try_cast(t).cast("string") for t in ("double", "float", "decimal(18,2)")])
    rows = spark.createDataFrame([(x,) for x in cells], "c string").select("c", tried.isNotNull().alias("casts"), may_be_number(c).alias("may"))
    rows = rows.collect()
    assert not [r.c for r in rows if r.casts and not r.may]
    assert not [r.c for r in rows if r.may and r.c.startswith(("oops", "Brand", "NATION", "infinite"))]


def test_inferred_types_of_padded_and_odd_cells(spark):
    from kpimart.sources.csv import infer_types

    rows = [(" true", " 1", "1e3", "2024-01-02 ", "\u0661", "NaN", "", "2024-01-02", "99999999999"),
            ("FALSE ", "+2\t", "-inf", " 2024-1-3", "x", "2", "a", "2024-01-02 03:04:05", "1")]
    df = spark.createDataFrame(rows, [f"c{i}" for i in range(9)])
    assert [f.dataType.simpleString() for f in infer_types(df).fields] == [
        "boolean", "int", "double", "date", "string", "double", "string", "timestamp", "bigint",
    ]
