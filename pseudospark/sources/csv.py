"""CSV in and out. Every field is opaque text, held by position.

Files are read line by line, so that they split between tasks and no line is lost: a line of white space is a record,
only an empty line is none. Where quoted fields hold line breaks, each line is a function from whether it starts inside
quotes to whether it ends there. These functions compose, first along each byte range and then over the ranges of a
file, so that every range knows how it starts and its lines are put together to records in parallel.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pseudospark.operators.resolve import BROADCAST_BYTES, measure

ROW = "_row"
#: Where a record stands; sorting by these is input order.
_PLACE = ["__file", "__block", "__line"]
#: Bad lines of at most so many fields are measured in the pass that finds them; wider ones take passes of their own.
FLAWED_WIDTH = 32
_BYTE_ORDER_MARK = "\ufeff"


@dataclass(frozen=True)
class CsvTable:
    """``df`` has ``_c0``, ``_c1``, ... and ``_row`` (to sort by for input order). ``header`` is None without one.

    ``bad_rows`` counts records with a stray quote or an open one at the end of the file; None in encodings of more than one
    byte a character and in files whose lines end in carriage returns alone, if quoted fields hold line breaks. ``in_order`` says that ``df`` comes in
    input order without a sort, which holds for a single file.
    """

    df: DataFrame
    header: list[str] | None
    width: int
    bad_rows: int | None
    in_order: bool


def _patterns(sep: str) -> tuple[str, str, str]:
    """Regular expressions for a clean line, a line that ends inside a quoted field, and a quoted field.

    All repetitions are possessive, so they need no stack however long the line.
    """
    s = re.escape(sep)
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    no_quote, any_char = (f'[^"{s}]', f"[^{s}]") if len(sep) == 1 else (f'(?:(?!{s})[^"])', f"(?:(?!{s})[\\s\\S])")
    clean = rf'(?:{quoted}|{no_quote}*+)'
    tolerated = rf'(?:{quoted}|{no_quote}{any_char}*+|)'
    return (
        rf"\A(?:{clean}{s})*+{clean}\z",
        rf'\A(?:{tolerated}{s})*+"[^"]*+(?:""[^"]*+)*+\z',
        quoted,
    )


def is_bad_line(line: Column, sep: str = ",") -> Column:
    """True for a line with a quote that neither opens, closes nor escapes."""
    clean, unfinished, _ = _patterns(sep)
    plain = ~F.contains(line, F.lit('"'))
    return F.when(plain, False).otherwise(~line.rlike(clean) & ~line.rlike(unfinished))


def _fields(line: Column, sep: str) -> Column:
    """Number of fields of a clean line."""
    _, _, quoted = _patterns(sep)
    visible = F.when(~F.contains(line, F.lit('"')), line).otherwise(F.regexp_replace(line, quoted, ""))
    rest = F.length(visible) - F.length(F.replace(visible, F.lit(sep), F.lit("")))
    return (rest / len(sep)).cast("int") + 1


def _ends_open(line: Column, sep: str) -> Column:
    _, unfinished, _ = _patterns(sep)
    return F.when(F.contains(line, F.lit('"')), line.rlike(unfinished)).otherwise(False)


def _options(sep: str) -> dict[str, str]:
    # The escape character must be the quote itself, or "a ""b"" c" stays raw.
    return {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])


def _parsed(line: Column, width: int, sep: str) -> Column:
    options = {**_options(sep), "multiLine": "true"}  # line breaks stay as they are
    return F.from_csv(line, _schema(width).simpleString()[len("struct<") : -1].replace(":", " "), options)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines that are not empty, with their places."""
    value = F.col("value")
    if encoding.lower().replace("-", "") not in ("utf8", "usascii", "ascii"):
        value = F.decode(value.cast("binary"), encoding)
    return (
        spark.read.text(path)
        .where("value <> ''")
        .select(value.alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
        .withColumn("__line", F.monotonically_increasing_id())
    )


def _records(spark: SparkSession, path: str, sep: str, encoding: str, width: int) -> DataFrame:
    """Records that may span lines, with their places; each file is read by one task."""
    reader = spark.read.options(**_options(sep)).option("encoding", encoding).option("multiLine", True)
    rows = reader.option("header", False).schema(_schema(width)).csv(path)
    return rows.select(
        *rows.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")
    ).withColumn("__line", F.monotonically_increasing_id())


def _used(cells: list[Column]) -> Column:
    """Number of fields up to the last one that a row has."""
    return F.greatest(F.lit(0), F.lit(0), *[F.when(c.isNotNull(), i + 1) for i, c in enumerate(cells)])


def _widest(cells: DataFrame, width: int) -> int:
    """Number of fields up to the last one that any row has."""
    return cells.agg(F.max(_used([F.col(f"_c{i}") for i in range(width)])).alias("used")).first()["used"] or 0


def _without_headers(spark: SparkSession, rows: DataFrame, firsts: list, has_header: list[bool]) -> DataFrame:
    """``rows`` without the first record of the files that have a header.

    All files have the same header, or only the first one does and the others go on with its rows; taking a data row for
    a header would lose it, so anything else is an error.
    """
    if not firsts:
        return rows
    if not all(has_header):
        if sum(has_header) > 1:
            raise ValueError(f"Of {len(firsts)} files {sum(has_header)} have the header of the first.")
        firsts = firsts[:1]
    # One row per file, as many as Spark's driver lists to plan the scan.
    places = spark.createDataFrame([tuple(f) for f in firsts], "__file string, __block long, __line long")
    return rows.join(F.broadcast(places), _PLACE, "left_anti")


def _table(rows: DataFrame, names: list[str], header: bool, width: int, bad_rows: int | None, files: int) -> CsvTable:
    df = rows.select(*[f"_c{i}" for i in range(width)], F.struct(*_PLACE).alias(ROW))
    return CsvTable(df, names if header else None, width, bad_rows, files <= 1)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    multi_line: bool | None = None,
) -> CsvTable:
    """Read CSV files, all rows whole: a row longer than the header keeps its extra fields.

    Files come in the order of their paths. Unless ``multi_line`` says so, one pass over the lines finds out whether quoted
    fields hold line breaks. Files split between tasks either way, unless their encoding has more than one byte a
    character, or quoted fields hold line breaks and lines end in carriage returns alone.
    """
    wide = encoding.lower().startswith(("utf-16", "utf16", "utf-32", "utf32"))
    if wide:
        return _read_records(spark, path, sep, header, encoding)
    if not multi_line:
        lines = _lines(spark, path, encoding)
        files = _profile(lines, sep)
        if multi_line is False or not sum(f.open_lines for f in files):
            return _read_lines(spark, lines, files, sep, header)
    joined = _joined_lines(spark, path, sep, encoding)
    if joined is None:
        return _read_records(spark, path, sep, header, encoding)
    records, in_order = joined
    table = _read_lines(spark, records, _profile(records, sep, whole=True), sep, header, whole=True)
    return replace(table, in_order=table.in_order and in_order)


def _profile(lines: DataFrame, sep: str, whole: bool = False) -> list:
    """For each file its first line, of its lines the bad and the open ones, the width of the good ones, ``flawed``, the
    width of the bad ones as the parser sees it (up to ``FLAWED_WIDTH``), and its ``bound``, their separators and one."""
    line = F.col("value")
    judged = lines.select(
        "*", _is_bad(line, sep, whole).alias("__bad"), _ends_open(line, sep).alias("__open"), _fields(line, sep).alias("__fields")
    )
    # Each is used more than once below, so it is a column of its own.
    parsed = F.when(F.col("__bad"), _parsed(line, FLAWED_WIDTH, sep))
    cells = judged.withColumn("__cells", parsed)
    separators = F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit("")))
    sized = cells.withColumn("__used", _used([F.col("__cells")[f"_c{i}"] for i in range(FLAWED_WIDTH)])).drop("__cells")
    return (
        sized.groupBy("__file")
        .agg(
            F.min(F.struct("__block", "__line", "value", F.col("__fields").alias("fields"))).alias("first"),
            F.sum(F.col("__bad").cast("long")).alias("bad_rows"),
            F.sum(F.col("__open").cast("long")).alias("open_lines"),
            F.max(F.when(~F.col("__bad"), F.col("__fields"))).alias("width"),
            F.max("__used").alias("flawed"),
            F.max(F.when(F.col("__bad"), separators / len(sep) + 1)).alias("bound"),
        )
        .orderBy("__file")
        .collect()
    )


def _is_bad(line: Column, sep: str, whole: bool) -> Column:
    """Of whole records those that end inside quotes are bad as well."""
    return is_bad_line(line, sep) | _ends_open(line, sep) if whole else is_bad_line(line, sep)


# -- records that span lines -----------------------------------------------------------------------------------------

#: What a line makes of being outside (0) or inside quotes (1): as two bits, the lower one for outside.
_KEEPS, _CLOSES, _OPENS, _SWAPS = 0b10, 0b00, 0b11, 0b01
_LINE_TYPE = "__file string, __block long, __line long, value string"


def _after(kinds: np.ndarray) -> np.ndarray:
    """For each place, 0 to all, the kind of all lines before it taken together."""
    n = len(kinds)
    swaps = np.concatenate([[0], np.cumsum(kinds == _SWAPS)])
    fixed = (kinds == _CLOSES) | (kinds == _OPENS)
    # The last line before each place that forgets what was before it, counted from 1.
    last = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, n + 1), 0)]))
    value = np.concatenate([[0], kinds == _OPENS])[last]
    odd = (swaps - swaps[last]) % 2
    settled = np.where(value ^ odd, _OPENS, _CLOSES)
    return np.where(last > 0, settled, np.where(odd, _SWAPS, _KEEPS))


def _composed(first: int, second: int) -> int:
    """The kind of two runs of lines after each other."""
    ends = [second >> (first >> start & 1) & 1 for start in (0, 1)]
    return ends[0] | ends[1] << 1


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Runs of rows of one file and block."""
    names, starts = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    edges = np.flatnonzero((np.diff(names) != 0) | (np.diff(starts) != 0)) + 1
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(starts)]):
        if end > begin:
            yield (batch.column(0)[begin].as_py(), int(starts[begin])), begin, end


def _block_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every byte range as one kind of line."""

    def row(key: tuple, kind: int, lone: bool) -> pa.RecordBatch:
        names = ["__file", "__block", "kind", "lone"]
        return pa.RecordBatch.from_pydict(dict(zip(names, [[key[0]], [key[1]], [kind], [lone]])))

    current, kind, lone = None, _KEEPS, False
    for batch in batches:
        kinds, lones = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        for key, begin, end in _blocks(batch):
            if key != current:
                if current is not None:
                    yield row(current, kind, lone)
                current, kind, lone = key, _KEEPS, False
            kind = _composed(kind, int(_after(kinds[begin:end])[-1]))
            lone = lone or bool(lones[begin:end].any())
    if current is not None:
        yield row(current, kind, lone)


def _block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each byte range. ``part`` is 1 for what a range holds of a record begun before it, 2 for a record that is
    open where the range ends, else 0."""
    current, inside, held, number, started = None, 0, [], 0, False

    def row(part: int) -> tuple:
        return (*current, number, "\n".join(held), part)

    for batch in batches:
        kinds, starts, values = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
        out: list[tuple] = []
        for key, begin, end in _blocks(batch):
            if key != current:
                if held:
                    out.append(row(2 if started and inside else 0 if started else 1))
                current, inside, held, number, started = key, int(starts[begin]), [], 0, False
            states = _after(kinds[begin:end]) >> inside & 1
            for outside, text in zip((states[:-1] == 0).tolist(), values.slice(begin, end - begin).to_pylist()):
                if outside:
                    if held:
                        out.append(row(0 if started else 1))
                    held, started = [], True
                    number += 1
                held.append(text)
            inside = int(states[-1])
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["__file", "__block", "__line", "value", "part"])
    if held:
        rest = row(2 if started and inside else 0 if started else 1)
        names = ["__file", "__block", "__line", "value", "part"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(rest, kinds)], names)


def _joined_lines(spark: SparkSession, path: str, sep: str, encoding: str) -> tuple[DataFrame, bool] | None:
    """Records that may span lines, with their places, read in parallel, and whether each file's come in order; None if
    lines end in carriage returns alone."""
    value = F.col("value")
    if encoding.lower().replace("-", "") not in ("utf8", "usascii", "ascii"):
        value = F.decode(value.cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), value.alias("value")
    )
    # A line that starts inside quotes is read like one that starts with a quote.
    line = F.regexp_replace("value", r"\r\z", "")
    outside, inside = _ends_open(line, sep), _ends_open(F.concat(F.lit('"'), line), sep)
    kind = outside.cast("int") + F.when(F.contains(line, F.lit('"')), inside.cast("int")).otherwise(1) * 2
    lone = F.contains(F.regexp_replace(line, _patterns(sep)[2], ""), F.lit("\r"))
    found = lines.select("__file", "__block", kind.alias("kind"), lone.alias("lone"))
    blocks = found.mapInArrow(_block_kinds, "__file string, __block long, kind long, lone boolean")
    # One row for each byte range; the same composition as along the lines.
    before = Window.partitionBy("__file").orderBy("__block")
    until = before.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("kind") == _SWAPS).cast("int")).over(until), F.lit(0))
    fixed = F.when(F.col("kind").isin(_OPENS, _CLOSES), F.struct((F.col("kind") == _OPENS).cast("int").alias("at"), "swaps"))
    placed = blocks.withColumn("swaps", swaps)
    last = F.last(fixed, ignorenulls=True).over(until)
    start = F.when(last.isNull(), F.col("swaps") % 2).otherwise((last["at"] + F.col("swaps") - last["swaps"]) % 2)
    # As many rows as Spark's driver lists to plan the scan.
    starts = placed.select("__file", "__block", start.cast("long").alias("start"), "lone").collect()
    if any(s.lone and not s.start for s in starts):
        return None
    known = spark.createDataFrame([tuple(s)[:3] for s in starts], "__file string, __block long, start long")
    small = measure(known, "__file") <= BROADCAST_BYTES
    known = F.broadcast(known) if small else known
    rows = lines.withColumn("kind", kind.cast("long")).join(known, ["__file", "__block"])
    rows = rows.select("__file", "__block", "kind", "start", "value")
    records = rows.mapInArrow(_block_records, f"{_LINE_TYPE}, part int")
    whole = records.where("part = 0")
    crossed = any(s.start for s in starts)
    if crossed:
        # A record that goes on in later ranges: what those hold of it is put behind its beginning.
        in_file = Window.partitionBy("__file").orderBy("__block", "__line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pieces = records.where("part > 0").withColumn("record", F.sum((F.col("part") == 2).cast("int")).over(in_file))
        piece = F.struct("__block", "__line", "value")
        merged = pieces.groupBy("__file", "record").agg(F.array_sort(F.collect_list(piece)).alias("all"))
        merged = merged.select(
            "__file", F.col("all")[0]["__block"].alias("__block"), F.col("all")[0]["__line"].alias("__line"),
            F.array_join(F.col("all.value"), "\n").alias("value"), F.lit(0).alias("part"),
        )
        whole = whole.unionByName(merged)
    else:
        whole = records
    ended = F.regexp_replace("value", r"\r\z", "").alias("value")
    return whole.select("__file", "__block", "__line", ended).where("value <> ''"), small and not crossed


def _read_lines(
    spark: SparkSession, lines: DataFrame, files: list, sep: str, header: bool, whole: bool = False
) -> CsvTable:
    bad_rows = sum(f.bad_rows for f in files)
    width = max((f.width or 1 for f in files), default=0)
    if bad_rows:
        # What the parser makes of bad lines decides their width, not their separators.
        found = max((f.flawed or 0 for f in files), default=0)
        if max(f.bound or 0 for f in files) > FLAWED_WIDTH:
            flawed = lines.where(_is_bad(F.col("value"), sep, whole))
            spare = 16
            while (found := _widest(flawed.select(_parsed(F.col("value"), width + spare, sep).alias("r")).select("r.*"), width + spare)) == width + spare:
                spare *= 2
        width = max(width, found)
    names: list[str] = []
    if files:
        first = files[0].first
        start = spark.createDataFrame([(first.value.removeprefix(_BYTE_ORDER_MARK),)], "value string")
        cells = start.select(_parsed(F.col("value"), max(width, first.fields), sep).alias("r")).select("r.*").first()
        names = ["" if v is None else v for v in cells][: first.fields]
    rows = lines
    if header:
        values = [f.first.value for f in files]
        rows = _without_headers(
            spark, lines, [(f["__file"], f.first["__block"], f.first["__line"]) for f in files], [v == values[0] for v in values]
        )
    rows = rows.select(_parsed(F.col("value"), max(width, 1), sep).alias("r"), *_PLACE).select("r.*", *_PLACE)
    return _table(rows, names, header, width, bad_rows, len(files))


def _read_records(spark: SparkSession, path: str, sep: str, header: bool, encoding: str) -> CsvTable:
    width = 16
    while (found := _widest(_records(spark, path, sep, encoding, width), width)) == width:
        width *= 2
    rows = _records(spark, path, sep, encoding, max(found, 1))
    cells = F.array(*[F.col(f"_c{i}") for i in range(max(found, 1))])
    firsts = rows.groupBy("__file").agg(F.min(F.struct("__block", "__line", cells.alias("cells"))).alias("first"))
    files = firsts.orderBy("__file").collect()
    names: list[str] = []
    if files:
        names = ["" if v is None else v for v in files[0].first.cells]
        while header and len(names) > 1 and files[0].first.cells[len(names) - 1] is None:
            names.pop()
        if names:
            names[0] = names[0].removeprefix(_BYTE_ORDER_MARK)
    if header:
        cells_of = [f.first.cells for f in files]
        places = [(f["__file"], f.first["__block"], f.first["__line"]) for f in files]
        rows = _without_headers(spark, rows, places, [c == cells_of[0] for c in cells_of])
    return _table(rows, names, header, found, None, len(files))


def write_csv(
    df: DataFrame,
    path: str,
    header: list[str] | None,
    sep: str = ",",
    encoding: str = "utf-8",
) -> None:
    """Write the columns by position, the header as the first row of the first part file.

    So the part files joined in order are one CSV file, and header names may repeat. ``read_csv`` knows such folders.
    """
    positions = [f"_c{i}" for i in range(len(df.columns))]
    cells = df.toDF(*positions).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in positions])
    if header is not None:
        first = df.sparkSession.createDataFrame([tuple(header)], _schema(len(positions))).coalesce(1)
        cells = first.unionByName(cells)
    (
        cells.write.mode("overwrite")
        .option("header", False)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        # An empty line would be no record; quotes make it one.
        .option("emptyValue", "" if len(positions) > 1 else '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
