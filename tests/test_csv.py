import csv
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pseudospark import ColumnMapping
from pseudospark.plans.csv_job import run_csv_job
from pseudospark.schemas import DEPSEUDONYMIZE, PSEUDONYMIZE
from pseudospark.sources.csv import is_bad_line, read_csv


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest().upper()


def joined(path):
    """All part files in order: one CSV file."""
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return "".join(open(os.path.join(path, p), encoding="utf-8", newline="").read() for p in parts)


def parsed(path, sep=","):
    return list(csv.reader(joined(path).splitlines(keepends=True), delimiter=sep))


@pytest.fixture
def job(spark, store, catalog, tmp_path):
    def run(content, mappings, direction=PSEUDONYMIZE, number=[0], **options):
        number[0] += 1
        source, target = tmp_path / f"in-{number[0]}.csv", str(tmp_path / f"out-{number[0]}")
        source.write_bytes(content if isinstance(content, bytes) else content.encode())
        result = run_csv_job(spark, str(source), target, mappings, direction, catalog, store, **options)
        return result, target

    return run


def test_simple(job):
    result, out = job("id,value\n1,secret\n", [ColumnMapping("value", "hashed")])
    assert joined(out) == f"id,value\n1,{sha('secret')}\n"
    assert (result.rows_processed, result.missing_value_count, result.bad_data_row_count) == (1, 0, 0)


def test_stray_quote_is_kept_and_counted(job):
    result, out = job('id,value\n1,se"cret\n2,fine\n', [ColumnMapping("value", "hashed")])
    assert parsed(out)[1:] == [["1", sha('se"cret')], ["2", sha("fine")]]
    assert (result.rows_processed, result.bad_data_row_count) == (2, 1)


def test_missing_values(job, store):
    result, out = job("id,value\n1,secret\n2,\n3,NA\n4,null\n", [ColumnMapping("value", "hashed")])
    assert parsed(out) == [["id", "value"], ["1", sha("secret")], ["2", ""], ["3", "NA"], ["4", "null"]]
    assert (result.rows_processed, result.missing_value_count) == (4, 3)
    assert store.read().count() == 1


def test_own_placeholders(job):
    result, out = job("id,value\n1,NA\n2,N/A\n", [ColumnMapping("value", "hashed")], placeholders=("N/A",))
    assert parsed(out)[1:] == [["1", sha("NA")], ["2", "N/A"]]
    assert result.missing_value_count == 1


def test_there_and_back_without_header(job):
    mapped = [ColumnMapping("1", "ns")]
    _, hidden = job("1,secret\n2,\n3,NA\n", mapped, header=False)
    assert parsed(hidden)[0][1] != "secret"
    result, shown = job(joined(hidden), mapped, DEPSEUDONYMIZE, header=False)
    assert parsed(shown) == [["1", "secret"], ["2", ""], ["3", "NA"]]
    assert result.missing_value_count == 2


def test_unknown_pseudonym_stays(job):
    _, out = job("id,value\n1,not-a-known-pseudonym\n", [ColumnMapping("value", "ns")], DEPSEUDONYMIZE)
    assert parsed(out)[1] == ["1", "not-a-known-pseudonym"]


def test_failures_name_columns_but_no_content(job):
    with pytest.raises(ValueError, match="no column 'nope'"):
        job("id,value\n1,secret\n", [ColumnMapping("nope", "ns")])
    with pytest.raises(ValueError, match="must be a column number"):
        job("1,secret\n", [ColumnMapping("value", "ns")], header=False)
    with pytest.raises(ValueError, match="no namespace 'gone'"):
        job("id,value\n1,secret\n", [ColumnMapping("value", "gone")])
    with pytest.raises(ValueError, match="No usable"):
        job("id,value\n1,secret\n", [ColumnMapping("value", " ")])


def test_appended_columns_and_repeated_header_names(job):
    mapped = [ColumnMapping("id", "hashed", target="id"), ColumnMapping("x", "hashed", target="n ew")]
    _, out = job("id,ID,id,x\na,b,c,d\n", mapped)
    assert parsed(out) == [["id", "ID", "id", "x", "id", "n ew"], ["a", "b", "c", "d", sha("a"), sha("d")]]


def test_quoted_line_breaks_quotes_and_spaces(job):
    content = 'id,value,note\r\n1,"two\nlines","say ""hi"", you"\r\n2,  spaced ,""\r\n'
    result, out = job(content, [ColumnMapping("value", "hashed")])
    assert parsed(out)[1:] == [["1", sha("two\nlines"), 'say "hi", you'], ["2", sha("  spaced "), ""]]
    assert result.rows_processed == 2 and result.bad_data_row_count == 0


def test_long_and_short_rows_lose_nothing(job):
    content = "id,value\n1,a,extra,more\n2\n3,c\n"
    result, out = job(content, [ColumnMapping("value", "hashed", target="p")])
    assert parsed(out) == [
        ["id", "value", "", "", "p"],
        ["1", "a", "extra", "more", sha("a")],
        ["2", "", "", "", ""],
        ["3", "c", "", "", sha("c")],
    ]
    assert result.missing_value_count == 1
    wide = ",".join(f"f{i}" for i in range(45))
    _, out = job(f'id,value\n"1\n2",a,{wide}\n', [ColumnMapping("value", "hashed")])
    assert parsed(out)[1] == ["1\n2", sha("a"), *wide.split(",")]


def test_other_delimiter_and_encoding(job):
    content = "id;näme\n1;Müller\n".encode("iso-8859-1")
    _, out = job(content, [ColumnMapping("näme", "hashed", target="p")], sep=";", encoding="iso-8859-1")
    part = [p for p in sorted(os.listdir(out)) if p.startswith("part-")]
    text = b"".join(open(os.path.join(out, p), "rb").read() for p in part).decode("iso-8859-1")
    assert text == f"id;näme;p\n1;Müller;{sha('Müller')}\n"


def test_byte_order_mark(job):
    _, out = job(b"\xef\xbb\xbfvalue,id\nsecret,1\n", [ColumnMapping("value", "hashed")])
    assert parsed(out) == [["value", "id"], [sha("secret"), "1"]]


@pytest.mark.parametrize("limit", [0, 64 << 20], ids=["shuffle", "broadcast"])
def test_rows_keep_their_order(job, store, limit):
    store.broadcast_bytes = limit
    lines = [f"{i},v{i % 700}" for i in range(5000)]
    result, out = job("id,value\n" + "\n".join(lines) + "\n", [ColumnMapping("value", "ns", target="p")])
    assert [r[0] for r in parsed(out)[1:]] == [str(i) for i in range(5000)]
    assert result.rows_processed == 5000 and store.read().count() == 700


def test_bad_lines_against_brute_force(spark):
    """Random lines over a small alphabet, judged by a character-by-character reading."""

    def judge(line):
        fields, i = [], 0
        while True:
            if line[i : i + 1] == '"':
                match = re.match(r'"(?:[^"]|"")*"(?=,|$)', line[i:])
                if not match:
                    unfinished = re.match(r'"(?:[^"]|"")*$', line[i:])
                    return "open" if unfinished and (line[i:].count('"') % 2 == 1) else "bad"
                i += match.end()
            else:
                end = line.find(",", i)
                end = len(line) if end < 0 else end
                fields.append('"' in line[i:end])
                i = end
            if i >= len(line):
                return "bad" if any(fields) else "clean"
            i += 1

    rng = random.Random(1)
    lines = ["".join(rng.choice('a",') for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    for row in df.select("value", is_bad_line(F.col("value")).alias("bad")).collect():
        verdict = judge(row.value)
        if verdict != "open":
            assert row.bad == (verdict == "bad"), row.value


def test_very_long_lines_need_no_stack(spark, tmp_path):
    long_field = '"' + 'x""y' * 200_000 + '"'
    (tmp_path / "long.csv").write_text(f'a,b\n{long_field},1\nse"x,{"," * 3}2\n')
    table = read_csv(spark, str(tmp_path / "long.csv"))
    rows = table.df.orderBy("_row").collect()
    assert rows[0]["_c0"] == 'x"y' * 200_000
    assert rows[1]["_c4"] == "2" and table.bad_rows == 1


def test_empty_file_with_header(job):
    result, out = job("id,value\n", [ColumnMapping("value", "hashed")])
    assert joined(out) == "id,value\n" and result.rows_processed == 0


def test_folders_of_files(spark, job, tmp_path):
    """Each file with a header, or parts of one file; anything else is refused."""

    def folder(name, *contents):
        path = tmp_path / name
        path.mkdir()
        for i, content in enumerate(contents):
            (path / f"part-{i:05d}.csv").write_text(content)
        return str(path)

    def rows(path):
        table = read_csv(spark, path)
        assert table.header == ["id", "value"]
        return sorted((r["_c0"], r["_c1"]) for r in table.df.collect())

    expected = [("1", "a"), ("2", "b"), ("3", "c")]
    assert rows(folder("each", "id,value\n1,a\n", "id,value\n2,b\n3,c\n")) == expected
    assert rows(folder("parts", "id,value\n", "1,a\n2,b\n", "3,c\n")) == expected
    with pytest.raises(ValueError, match="Of 3 files 2 have the header"):
        read_csv(spark, folder("mixed", "id,value\n1,a\n", "id,value\n2,b\n", "3,c\n"))


def test_output_of_one_job_is_input_of_the_next(spark, job, store, catalog, tmp_path):
    mapped = [ColumnMapping("value", "ns")]
    lines = [f"{i},v{i}" for i in range(300)]
    source = tmp_path / "many"
    source.mkdir()
    for part in range(3):
        (source / f"{part}.csv").write_text("id,value\n" + "\n".join(lines[part::3]) + "\n")
    hidden, shown = str(tmp_path / "hidden"), str(tmp_path / "shown")
    run_csv_job(spark, str(source), hidden, mapped, PSEUDONYMIZE, catalog, store)
    assert len([p for p in os.listdir(hidden) if p.startswith("part-")]) > 1
    run_csv_job(spark, hidden, shown, mapped, DEPSEUDONYMIZE, catalog, store)
    got = parsed(shown)
    assert got[0] == ["id", "value"]
    assert sorted(got[1:]) == sorted(line.split(",") for line in lines)


def test_parts_of_one_file_lose_no_row_equal_to_the_header(spark, job, tmp_path):
    source = tmp_path / "parts"
    source.mkdir()
    parts = ["id,value\n1,a\nid,value\n", "2,b\n", "3,c\nid,value\n4,d\n", ""]
    for i, text in enumerate(parts):
        (source / f"part-{i:05d}.csv").write_text(text)
    table = read_csv(spark, str(source))
    rows = [(r["_c0"], r["_c1"]) for r in table.df.orderBy("_row").collect()]
    assert rows == [("1", "a"), ("id", "value"), ("2", "b"), ("3", "c"), ("id", "value"), ("4", "d")]


def test_input_order_whatever_the_sizes_of_files(spark, store, catalog, tmp_path):
    source, target = tmp_path / "sized", str(tmp_path / "sized-out")
    source.mkdir()
    (source / "part-00000.csv").write_text("id,value\n0,x\n")
    (source / "part-00001.csv").write_text("".join(f"{i},v{i}\n" for i in range(1, 3000)))
    run_csv_job(spark, str(source), target, [ColumnMapping("value", "hashed")], PSEUDONYMIZE, catalog, store)
    assert [r[0] for r in parsed(target)[1:]] == [str(i) for i in range(3000)]


def test_white_space_lines_are_records(spark, job, tmp_path):
    (tmp_path / "one.csv").write_text("v\n1\n   \n\n2\n")
    table = read_csv(spark, str(tmp_path / "one.csv"))
    assert [r["_c0"] for r in table.df.orderBy("_row").collect()] == ["1", "   ", "2"]
    result, out = job('v\na\n""\nb\n', [ColumnMapping("v", "hashed")])
    assert (result.rows_processed, result.missing_value_count) == (3, 1)
    again = read_csv(spark, out)
    assert [r["_c0"] or "" for r in again.df.orderBy("_row").collect()] == [sha("a"), "", sha("b")]


def test_long_delimiter(job):
    _, out = job('id||value||n|te\n1||"a||b"||c|d\n', [ColumnMapping("value", "hashed")], sep="||")
    assert joined(out) == f"id||value||n|te\n1||{sha('a||b')}||c|d\n"


def test_bad_line_with_a_quoted_separator_widens_nothing(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('id,value\n"1,2",se"cret\n3,fine\n')
    table = read_csv(spark, str(tmp_path / "bad.csv"))
    assert (table.width, table.bad_rows) == (2, 1)
    assert [(r["_c0"], r["_c1"]) for r in table.df.orderBy("_row").collect()] == [("1,2", 'se"cret'), ("3", "fine")]


@pytest.mark.parametrize("fields, passes", [(5, 0), (40, 1)])
def test_bad_lines_are_measured_by_the_first_pass(spark, workspace, monkeypatch, fields, passes):
    """The parser's width of bad lines comes from the pass that finds them; only very wide ones take another."""
    from pseudospark.sources import csv

    calls, widest = [], csv._widest
    monkeypatch.setattr(csv, "_widest", lambda cells, width: calls.append(width) or widest(cells, width))
    path = workspace.path("in")
    wide = ",".join(['x"y', *["w"] * (fields - 2), "z"])
    spark.createDataFrame([("a,b",), (wide,)], "value string").coalesce(1).write.text(path)
    read = csv.read_csv(spark, path, header=False)
    assert (read.width, read.bad_rows, bool(calls)) == (fields, 1, bool(passes))
    assert {r[f"_c{fields - 1}"] for r in read.df.collect()} == {None, "z"}
