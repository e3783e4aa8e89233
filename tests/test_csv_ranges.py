"""Records that span lines, read in parallel over byte ranges."""

import csv
import io
import random

import numpy as np
import pytest

from pseudospark.sources import csv as module
from pseudospark.sources.csv import ROW, read_csv


@pytest.fixture
def small_splits(spark):
    """Byte ranges of 300 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def cells(table):
    columns = [f"_c{i}" for i in range(table.width)]
    return [tuple(r[c] or "" for c in columns) for r in table.df.orderBy(ROW).collect()]


def random_rows(rng, n):
    texts = ["", "plain", "two\nlines", 'say "hi"', "a;b,c", "\n\n", 'x"\ny', " spaced ", "crlf\r\ninside", "long " * 120, "\n" * 400]
    return [(str(i), rng.choice(texts), rng.choice(texts)) for i in range(n)]


def written(rows, **options):
    out = io.StringIO()
    csv.writer(out, **options).writerows(rows)
    return out.getvalue().encode()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(3))
def test_any_ranges(spark, tmp_path, small_splits, seed, end):
    rows = random_rows(random.Random(seed), 60)
    for part in range(2):
        (tmp_path / f"{part}.csv").write_bytes(written([("id", "a", "b"), *rows[30 * part : 30 * part + 30]], lineterminator=end))
    table = read_csv(spark, str(tmp_path))
    assert (table.header, table.width, table.bad_rows) == (["id", "a", "b"], 3, 0)
    assert cells(table) == rows
    assert table.df.rdd.getNumPartitions() > 10  # several tasks read one file


def test_order_of_a_file_in_one_range(spark, tmp_path):
    rows = random_rows(random.Random(7), 40)
    (tmp_path / "one.csv").write_bytes(written(rows))
    table = read_csv(spark, str(tmp_path / "one.csv"), header=False)
    assert table.in_order
    assert [r._c0 for r in table.df.collect()] == [r[0] for r in rows]


@pytest.mark.parametrize("multi_line", [None, True])
def test_bad_rows_beside_line_breaks(spark, tmp_path, small_splits, multi_line):
    lines = []
    for i in range(50):
        lines.append(f'{i},"line one\nline two, ""quoted""",end')
        lines.append(f'{i},st"ray,end')
        lines.append(f"{i},plain,end")
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    table = read_csv(spark, str(tmp_path / "x.csv"), header=False, multi_line=multi_line)
    assert table.bad_rows == 50
    found = cells(table)
    assert len(found) == 150 and found[0] == ("0", 'line one\nline two, "quoted"', "end") and found[1] == ("0", 'st"ray', "end")


def test_quote_left_open_at_the_end(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n' + "2,x\n" * 200 + '3,"never\nclosed\n' + "4,y\n" * 200)
    table = read_csv(spark, str(tmp_path / "x.csv"))
    assert table.bad_rows == 1
    assert table.df.count() == 202


def test_carriage_returns_alone(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'a,b\r1,"two\rlines"\r2,x\r')
    table = read_csv(spark, str(tmp_path / "x.csv"))
    assert table.bad_rows is None
    assert table.df.count() == 2


def test_long_delimiter_and_encoding(spark, tmp_path, small_splits):
    rows = [f'{i}||"é\nü || {i}"||z' for i in range(80)]
    (tmp_path / "x.csv").write_bytes("\n".join(rows).encode("iso-8859-1"))
    table = read_csv(spark, str(tmp_path / "x.csv"), sep="||", header=False, encoding="iso-8859-1")
    assert cells(table) == [(str(i), f"é\nü || {i}", "z") for i in range(80)] and table.bad_rows == 0


def test_functions_of_lines_compose():
    rng = random.Random(2)
    for _ in range(200):
        kinds = [rng.randrange(4) for _ in range(rng.randrange(12))]
        before = module._after(np.array(kinds, int))
        for start in (0, 1):
            state = start
            for i, kind in enumerate([*kinds, None]):
                assert before[i] >> start & 1 == state
                if kind is not None:
                    state = kind >> state & 1
        cut = rng.randrange(len(kinds) + 1)
        parts = [int(module._after(np.array(k, int))[-1]) for k in (kinds[:cut], kinds[cut:])]
        assert module._composed(*parts) == before[-1]
