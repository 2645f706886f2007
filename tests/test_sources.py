"""Readers on small files."""

from __future__ import annotations

import csv
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.functions.records import accepted, rejected, rendered
from logweir.sources import files, splits
from logweir.sources.formats import UnsupportedFormat, detect_format
from logweir.sources.query import UnreadableQuery, preview, read_query


def write(folder, name: str, text: str, encoding: str = "utf-8") -> str:
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(records):
    return accepted(records).orderBy("source_id", "block", "line").collect()


def test_plain_text_drops_blank_lines_and_keeps_leading_spaces(spark, tmp_path):
    path = write(tmp_path, "a.log", "first\r\n\n \t \n  second\n")
    assert [row.raw_line for row in rows(files.read_plain_text(spark, path))] == ["first", "  second"]


def test_csv_with_quoted_lines(spark, tmp_path):
    path = write(
        tmp_path,
        "a.csv",
        '"timestamp","end_time","container_name","pod_name","raw_line"\n'
        '"2026-06-01 00:00:10","2026-06-01 00:00:11","driver","pod-1","first line\nsecond ""line"""\n'
        ",,,,\n"
        '"2026-06-01 00:00:12","","driver","","third"\n',
    )
    found = rows(files.read_csv_logs(spark, path))
    assert [row.raw_line for row in found] == ['first line\nsecond "line"', "third"]
    assert (found[0].container_name, found[0].pod_name, found[0].end_time) == ("driver", "pod-1", "2026-06-01 00:00:11")


def test_csv_files_of_different_dialects_and_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "timestamp,service,severity,raw_line\n2026-01-01,payments,error,boom\n2026-01-02,x,y,z\n")
    write(tmp_path, "b.tsv", "\ufeffmessage\ttime\nhello\tt1\nbye\tt2\n")
    write(tmp_path, "c.csv", "log;pod\nl1;p1\nl2;p2\n")
    found = {(row.raw_line, row.timestamp, row.pod_name, tuple(sorted(row.attrs.items()))) for row in rows(files.read_csv_logs(spark, str(tmp_path)))}
    assert found == {
        ("boom", "2026-01-01", "", (("service", "payments"), ("severity", "error"))),
        ("z", "2026-01-02", "", (("service", "x"), ("severity", "y"))),
        ("hello", "t1", "", ()),
        ("bye", "t2", "", ()),
        ("l1", "", "p1", ()),
        ("l2", "", "p2", ()),
    }


def test_csv_surplus_cells_are_kept_however_many(spark, tmp_path):
    surplus = [str(i) for i in range(40)]
    path = write(tmp_path, "a.csv", "log,pod\nx,p\n" + ",".join(["y", "q", *surplus]) + "\nz\n")
    found = rows(files.read_csv_logs(spark, path))
    assert [row.raw_line for row in found] == ["x", "y", "z"]
    assert found[1].attrs == {"_extra": " ".join(surplus)}
    assert found[2].pod_name == "" and found[0].attrs == {}


def test_markdown_table(spark, tmp_path):
    path = write(
        tmp_path,
        "a.md",
        "intro\n|timestamp|namespace|raw_line|\n|---------|:--:|--------|\n"
        "|2026-03-18|kube|path=C:\\tmp\\file msg=a\\|b|\n"
        "|2026-03-19|kube|one|two|three|\n|2026-03-20|short|\n| | | |\n|t|n|ends with \\\\|\n",
    )
    found = rows(files.read_markdown_table(spark, path))
    assert [row.raw_line for row in found] == [
        "path=C:\\tmp\\file msg=a|b",
        "one|two|three",
        "2026-03-20 short",
        "ends with \\\\",
    ]
    assert found[0].namespace == "kube"


def test_markdown_needs_a_data_row(spark, tmp_path):
    path = write(tmp_path, "a.md", "|timestamp|raw_line|\n")
    assert [row.reject_reason for row in rejected(files.read_markdown_table(spark, path)).collect()]


def test_json_array_inside_an_object(spark, tmp_path):
    payload = {
        "SELECT [x] ...": [
            {"timestamp": "t1", "Message": "level=error", "n": 7, "ok": True, "nothing": None},
            {"raw_line": "", "text": "never", "pod": "p", "deep": {"a": 1}},
            "plain",
            3,
            False,
        ],
        "other": [1],
    }
    path = write(tmp_path, "a.json", json.dumps(payload))
    found = rows(files.read_json_array(spark, path))
    assert sorted(row.raw_line for row in found) == sorted(["level=error", 'never p {"a":1}', "plain", "3", "False"])
    first = next(row for row in found if row.raw_line == "level=error")
    assert first.timestamp == "t1" and first.attrs == {"n": "7", "ok": "True"}


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}, {"b": '])
def test_json_without_a_whole_array_is_rejected(spark, tmp_path, text):
    path = write(tmp_path, "a.json", text)
    records = files.read_json_array(spark, path)
    assert accepted(records).count() == 0 and rejected(records).count() == 1


def test_unknown_columns_are_rendered(spark, tmp_path):
    path = write(tmp_path, "a.csv", "timestamp,service,severity,raw_line\n2026-01-01,payments,error,boom\n")
    line = rendered(accepted(files.read_csv_logs(spark, path))).first().rendered
    assert line == "[2026-01-01 -> 2026-01-01]  service=payments  severity=error  boom"


def test_missing_raw_line_column_is_a_reject(spark, tmp_path):
    path = write(tmp_path, "a.csv", "timestamp,log\nt,x\n")
    reasons = [row.reject_reason for row in files.read_csv_logs(spark, path, "body").collect()]
    assert reasons == ["no column holds the log line"]


def test_read_logs_goes_by_file_name(spark, tmp_path):
    write(tmp_path, "a.csv", "log,pod\nfrom csv,p\n")
    write(tmp_path, "b.log", "from text\n")
    write(tmp_path, "c.json", '["from json"]')
    write(tmp_path, "d.md", "|log|\n|---|\n|from table|\n")
    assert {row.raw_line for row in rows(files.read_logs(spark, str(tmp_path)))} == {
        "from csv", "from text", "from json", "from table",
    }
    with pytest.raises(UnsupportedFormat):
        files.read_logs(spark, str(tmp_path), "xml")


@pytest.mark.parametrize(
    ("name", "kind", "asked", "expected"),
    [
        ("logs.csv", "", "auto", "csv"),
        ("logs.MD", "", "", "markdown"),
        ("logs.json", "text/csv", None, "json"),
        ("logs.txt", "text/plain", "auto", "plain_text"),
        ("logs.txt", "application/json", "auto", "json"),
        ("dir.json/logs", "", "auto", "csv"),
        (".json", "", "auto", "csv"),
        ("x", "text/plain; charset=utf-8", "auto", "plain_text"),
        ("x.json", "", " Markdown ", "markdown"),
        ("x.json", "", "xml", None),
    ],
)
def test_detect_format(spark, name, kind, asked, expected):
    df = spark.createDataFrame([(name, kind, asked)], "n string, k string, a string")
    assert df.select(detect_format(F.col("n"), F.col("k"), F.col("a"))).first()[0] == expected


def test_query_source(spark):
    spark.createDataFrame([("t", "ns", "api", "error", "boom")], "timestamp string, namespace string, container_name string, severity string, raw_line string").createOrReplaceTempView("source_rows")
    row = read_query(spark, " SELECT * FROM source_rows; ").first()
    assert (row.raw_line, row.namespace, row.attrs) == ("boom", "ns", {"severity": "error"})
    for bad in ("", " ; ", "drop table x", "selectx"):
        with pytest.raises(UnreadableQuery):
            read_query(spark, bad)
    with pytest.raises(UnreadableQuery):
        read_query(spark, "select * from source_rows where false")
    assert preview(spark, "select * from range(1000)", 0).count() == 1
    assert preview(spark, "with a as (select * from range(1000)) select * from a", 900).count() == 500


def test_csv_headers_of_any_width_and_files_without_one(spark, tmp_path):
    from logweir.sources.files import read_csv_logs

    names = [f"column_with_a_rather_long_name_{n}" for n in range(2_500)]
    (tmp_path / "wide.csv").write_text(",".join([*names, "raw_line"]) + "\n" + ",".join(["v"] * 2_500 + ["the line"]) + "\n")
    (tmp_path / "blank.csv").write_text("\n  \n\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "small.csv").write_text("timestamp,raw_line\n2024-01-01,hello\n")
    rows = {row.source_id.rsplit("/", 1)[1]: row for row in read_csv_logs(spark, str(tmp_path)).collect()}
    assert rows["wide.csv"].raw_line == "the line" and len(rows["wide.csv"].attrs) == 2_500
    assert rows["small.csv"].raw_line == "hello" and rows["small.csv"].reject_reason is None
    assert rows["blank.csv"].reject_reason == rows["none.csv"].reject_reason == "no header line"


@settings(max_examples=600, deadline=None)
@given(lines=st.lists(st.text(alphabet='a",; ', max_size=8), min_size=1, max_size=6), skip_space=st.booleans())
def test_csv_states_are_those_of_the_csv_module(lines, skip_space):
    """A line begins inside a cell where the csv module has not ended the record of the lines before."""
    form = splits.CsvLines(",", '"', skip_space)
    step, state, begins = form.stepper(), 0, []
    for at, line in enumerate(lines):
        if not state:
            begins.append(at)
        state = step(line, state)
    reader = csv.reader((line + "\n" for line in lines), skipinitialspace=skip_space)
    ends = [0] + [reader.line_num for _ in reader]
    assert begins == ends[:-1]
    for cut in range(len(lines) + 1):
        told = form.applied(form.effect(lines[cut:]), form.applied(form.effect(lines[:cut]), form.start))
        assert told == (state,)


JSON_PARTS = st.lists(st.sampled_from(['"', "[", "]", "{", "}", ",", "a", " ", '"x,]"', '\\"', ":"]), max_size=24).map("".join)


@settings(max_examples=600, deadline=None)
@given(text=JSON_PARTS, cuts=st.sets(st.integers(1, 12), max_size=3))
def test_json_effects_compose_to_the_state_of_a_plain_reading(text, cuts):
    form = splits.JsonItems()
    lines = text.split(",")
    where, inside, depth = form.start
    for line in lines:
        inside, found = form.brackets(line, inside)
        for _, kind in found:
            if where == splits.BEFORE and kind == 2:
                where, depth = splits.WITHIN, 1
            elif where == splits.WITHIN:
                depth += -1 if kind < 0 else 1
                where, depth = (splits.BEYOND, 0) if depth == 0 else (where, depth)
    want = (where, 0, 0) if where == splits.BEYOND else (where, inside, depth)
    bounds = [0, *sorted(cut for cut in cuts if cut < len(lines)), len(lines)]
    state = form.start
    for start, end in zip(bounds[:-1], bounds[1:]):
        state = form.applied(form.effect(lines[start:end]), state)
    assert state == want


@pytest.fixture
def small_splits(spark):
    """Files above a few hundred bytes are split."""
    sizes = {"spark.sql.files.maxPartitionBytes": "2000b", "spark.sql.files.openCostInBytes": "1b"}
    old = {name: spark.conf.get(name) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def splits_read(spark, path: str) -> int:
    return splits.lines_of(spark, path).select("source_id", "block").distinct().count()


@pytest.mark.parametrize("seed", [1, 2])
def test_one_csv_file_over_many_splits(spark, tmp_path, small_splits, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice('ab,"\n é') for _ in range(draw.choice([1, 3, 30, 30, 200])))
    body = [[f"t{n}", word(), word()] for n in range(80)] + [["t80", "x" * 3_000 + '"\n,' + "y" * 3_000, "long"]] + [[f"t{n}", "z", word()] for n in range(81, 100)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n").writerows([["timestamp", "raw_line", "other"], *body])
    assert splits_read(spark, str(tmp_path)) > 4
    found = rows(files.read_csv_logs(spark, str(tmp_path)))
    assert [row.timestamp for row in found] == [row[0] for row in body]
    for row, (_, line, other) in zip(found, body):
        assert row.raw_line == (line.strip() or f"{row.timestamp} {other.strip()}".strip())
        assert row.attrs.get("other", "") == other.strip()


def test_a_csv_file_that_ends_inside_a_cell(spark, tmp_path, small_splits):
    lines = [f"t{n},line {n}" for n in range(300)] + ['t300,"never closed', *[f"more {n}" for n in range(100)]]
    path = write(tmp_path, "a.csv", "timestamp,raw_line\n" + "\n".join(lines) + "\n")
    found = rows(files.read_csv_logs(spark, path))
    assert len(found) == 301
    assert found[-1].raw_line == "\n".join(["never closed", *[f"more {n}" for n in range(100)]])


@pytest.mark.parametrize(("seed", "indent"), [(1, None), (2, 2)])
def test_one_json_file_over_many_splits(spark, tmp_path, small_splits, seed, indent):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice('ab,"\\[]{} é') for _ in range(draw.choice([1, 3, 30, 30, 200])))
    items = [{"timestamp": f"t{n}", "raw_line": f"{n} {word()}|", "deep": {"a": [n, word()]}} for n in range(60)]
    items += [{"timestamp": "t60", "raw_line": "x" * 3_000 + ',"],' + "y" * 3_000}, "plain, text", 7, [1, 2]]
    path = write(tmp_path, "a.json", json.dumps({"SELECT [1]": "no, [", "rows": items, "other": [word()] * 50}, indent=indent))
    assert splits.lines_of(spark, path, ",").select("block").distinct().count() > 4
    found = rows(files.read_json_array(spark, path))
    want = [(item["timestamp"], item["raw_line"]) for item in items if isinstance(item, dict)] + [("", "plain, text"), ("", "7"), ("", "[1,2]")]
    assert [(row.timestamp, row.raw_line) for row in sorted(found, key=lambda row: (row.block, row.line))] == want


@pytest.mark.parametrize("end", ["", ', {"a": }]', ']'])
def test_a_large_json_file_is_taken_whole_or_not(spark, tmp_path, small_splits, end):
    path = write(tmp_path, "a.json", '{"rows": [' + ", ".join(f'{{"raw_line": "line {n}"}}' for n in range(200)) + end)
    records = files.read_json_array(spark, path)
    good = 200 if end == "]" else 0
    assert (accepted(records).count(), rejected(records).count()) == (good, 0 if good else 1)


def test_empty_json_files_and_arrays(spark, tmp_path):
    write(tmp_path, "none.json", "")
    write(tmp_path, "array.json", " [ ] ")
    write(tmp_path, "text.json", '"[1]"')
    reasons = {row.source_id.rsplit("/", 1)[1]: row.reject_reason for row in files.read_json_array(spark, str(tmp_path)).collect()}
    assert reasons == {"none.json": "no array in the JSON text", "text.json": "no array in the JSON text"}


def test_a_json_file_taken_whole_gives_what_its_comma_parts_give():
    draw = random.Random(5)
    parts = ['{"a": 1, "b": "x,]}"}', '{"a": {"b": [1, 2]}}', " 7 ", '"q\\"]"', "[1, [2]]", "", "{", "]", '"open', "}", "\\,", "null", "{}"]
    for _ in range(3_000):
        text = draw.choice(["[", '{"k": [', '{"[": 1, "k": [', "", " [ ", '"['])
        text += ",".join(draw.choice(parts) for _ in range(draw.randrange(6))) + draw.choice(["]", "]}", '], "other": [1]}', ""])
        found = list(splits.JsonItems().read(iter(enumerate(text.split(","))), (splits.BEFORE, 0, 0), True, True))
        _, texts, error = splits.JsonItems().whole(text)
        assert [error] * bool(error) == [item.error for item in found if item.error], text
        # Items of a file with an error don't count.
        assert error or texts == [item.cells[0] for item in found if item.cells], text


def test_small_json_files_are_one_row_and_large_ones_are_not(spark, tmp_path, small_splits):
    write(tmp_path, "small.json", '[{"raw_line": "one"}, "two"]')
    write(tmp_path, "large.json", "[" + ",".join(f'"line {n}"' for n in range(900)) + "]")
    size = (tmp_path / "small.json").stat().st_size
    small = splits.whole_files(spark, str(tmp_path), F.col("_metadata.file_size") <= size)
    # The large file isn't scanned: whole, it might be more than a row holds.
    assert small.count() == 1 and small.rdd.getNumPartitions() == 1
    found = rows(files.read_json_array(spark, str(tmp_path)))
    assert {row.raw_line for row in found} == {"one", "two", *[f"line {n}" for n in range(900)]}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_worked_out_once_below_a_filter(spark, tmp_path):
    table = write(tmp_path, "a.md", "| time | message |\n|---|---|\n| t1 | one \\| two |\n| t2 | |\n")
    read = accepted(files.read_markdown_table(spark, table))
    assert sorted(row.raw_line for row in read.collect()) == ["one | two", "t2"]
    assert plan_of(read).count("transform_keys") == 1 and plan_of(read).count("regexp_extract_all") == 2
    texts = write(tmp_path, "a.json", '[{"time": "t1", "message": "one"}, "two"]')
    read = accepted(files.read_json_array(spark, texts))
    assert sorted(row.raw_line for row in read.collect()) == ["one", "two"]
    assert plan_of(read).count("transform_keys") == 1 and "MapInArrow" not in plan_of(read)
