"""Conversations checked for faults and repaired by the cheapest edits that fit the grammar ``(s?(ua)+)?``.

Conversations of ordinary length are worked on one by one in tasks that hold several. Long ones are cut into parts of
a fixed number of turns: each part is aligned between every two places of the grammar, a stream over the parts' costs
chooses among them, and texts are read only once the edits are known. No task holds a long conversation's turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pseudospark.llm import alignment
from pseudospark.llm.alignment import ASSISTANT, START, SYSTEM, USER
from pseudospark.operators.ordered import numbered
from pseudospark.operators.resolve import attach, broadcast_if_small, measure
from pseudospark.sources.files import Workspace

#: Conversations of more turns, or more bytes of text, are cut into parts.
LONG_TURNS = 1024
LONG_BYTES = 16 << 20
PART_TURNS = 256
#: Results that a task sends on at once.
ROWS = 2000

_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_FAR = 1 << 60
COUNTS = ["n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

Turn = tuple[int | None, str, str]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present`` with faults set by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes the user its speaker. Nulls are
    read as one space. A dropped row stays with ``present`` false, so that its conversation is not forgotten.
    """

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    role, text = filled("role"), filled("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def letter_of(role: str) -> str:
    return role[:1] if role[:1] in ("u", "a", "s") else "o"


def judged(turns: list[Turn]) -> tuple[str, dict[str, int]]:
    """The turns' letters for the alignment, and the number of faults of each kind; a turn has its first fault only."""
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    seen: set[tuple[str, str]] = set()
    letters = []
    for _, role, text in turns:
        letter = letter_of(role)
        said = text.rstrip(_SPACE)
        if not said:
            counts["blank"] += 1
            letter = alignment.GONE
        elif (role, text) in seen:
            counts["duplicate"] += 1
            letter = alignment.GONE
        elif said[-1] not in ".!?":
            counts["truncated"] += 1
            letter = letter.upper()
        seen.add((role, text))
        letters.append(letter)
    return "".join(letters), counts


def gaps_of(numbers: set[int]) -> int:
    """Missing turn numbers between the least and the greatest."""
    return max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0


def applied(turns: list[tuple[str, str]], audit: str, place: int = START) -> list[tuple[str, str]]:
    """The repaired turns; ``place`` tells where in the grammar the first one stands."""
    out = []
    rows = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and place == START and role[:1] == "s":
            place = SYSTEM
        else:
            place = ASSISTANT if place == USER else USER
            if edit != "K":
                role = "assistant" if place == ASSISTANT else "user"
        out.append((role, text))
    return out


def _illegal(initials: list[str]) -> int:
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))


def _lines(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode("utf-8", "surrogatepass")


def repair_one(turns: list[Turn]) -> tuple:
    """Counts, audit, whether a system turn leads, and the digest of the repaired turns of one conversation."""
    letters, counts = judged(turns)
    cost, audit = alignment.whole(letters)
    result = applied([t[1:] for t in turns], audit)
    return (
        len(turns),
        gaps_of({number for number, _, _ in turns if number is not None}),
        *counts.values(),
        _illegal([role[:1] for _, role, _ in turns]),
        cost,
        audit,
        bool(result) and result[0][0][:1] == "s",
        hashlib.sha256(_lines(result)).hexdigest(),
    )


def _result_type(source: DataFrame) -> StructType:
    rest = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, system_first boolean, repaired_sha256 string"
    return StructType([StructField("conv_id", source.schema["conv_id"].dataType), *StructType.fromDDL(rest).fields])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in their first columns, in sorted input; one run is held at a time."""
    key, run = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if key != row[:keys]:
                if key is not None:
                    yield key, run
                key, run = row[:keys], []
            run.append(row[keys:])
    if key is not None:
        yield key, run


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _over_sorted(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], types: StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(types)
    return df.mapInArrow(lambda batches: _batched(work(batches), schema), types)


def repaired(
    conversations: DataFrame,
    workspace: Workspace,
    *,
    long_turns: int = LONG_TURNS,
    long_bytes: int = LONG_BYTES,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations`` (``conv_id, turn, role, text`` and, if given, ``present``).

    ``n_turns, gaps, blank, duplicate, truncated, illegal, cost`` (long), ``audit`` (initials of the cheapest edits, the least
    in ASCII order), ``system_first`` and ``repaired_sha256`` (of the repaired ``role:text`` lines). Turns are taken in the order
    of ``turn``, nulls first, ties by role and text; null roles and texts are one space, a null id is a conversation.
    Rows whose ``present`` is false only name their conversation; one without other rows has zeros, an empty audit and
    the digest of no text. Conversations of more than ``long_turns`` turns or ``long_bytes`` bytes are cut into parts of
    ``part_turns`` turns, with the same results. ``gaps`` counts modulo 2^64 where turn numbers lie further apart than a long can tell. Other
    columns are ignored.
    """
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    blank = F.lit(" ")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        F.coalesce(present, F.lit(False)).alias("present"),
    )
    sizes = rows.where("present").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    )
    long = workspace.save(sizes.where((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)), "long")
    types = _result_type(rows)
    if long.isEmpty():
        return _ordinary(rows, types)
    long = long.select(F.col("conv_id").alias("long_id"), _key(F.col("conv_id")).alias("key"), "n")
    long = broadcast_if_small(long, "key")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    some = _ordinary(rows.join(long, same, "left_anti"), types)
    cut = rows.where("present").join(long, same)
    return some.unionByName(_long(cut, long, workspace, types, part_turns))


def _key(id: Column) -> Column:
    return F.when(id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), id.cast("string")))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _ordinary(rows: DataFrame, types: StructType) -> DataFrame:
    """Conversations that fit a task, each read and repaired as a whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (id,), run in _grouped(batches, 1):
            yield id, *_wrapped(repair_one([row[:3] for row in run if row[3]]))

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return _over_sorted(ordered, work, types)


def _wrapped(result: tuple) -> tuple:
    return result[0], (result[1] + (1 << 63)) % (1 << 64) - (1 << 63), *result[2:]


# -- long conversations ----------------------------------------------------------------------------------------------


def _letters(rows: DataFrame) -> DataFrame:
    """``fault`` and ``letter`` of numbered turns; ``first`` is the number of the first turn that says the same."""
    said = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (
        F.when(said == "", "blank")
        .when(F.col("first") < F.col("row_number"), "duplicate")
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    return rows.withColumn("fault", fault).withColumn(
        "letter",
        F.when(F.col("fault").isin("blank", "duplicate"), alignment.GONE)
        .when(F.col("fault") == "truncated", F.upper(letter))
        .otherwise(letter),
    )


def _numbered_turns(cut: DataFrame, workspace: Workspace, part_turns: int) -> DataFrame:
    """Turns of long conversations with their number, their part, and what is wrong with them."""
    rows = numbered(cut.select("key", "n", "turn", "role", "text"), ["key"], _order(), workspace)
    rows = workspace.save(rows.withColumn("digest", F.sha2("text", 256)), "numbered")
    said = ["key", "role", "digest"]
    counts = rows.groupBy(*said).agg(F.min("row_number").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = workspace.save(counts, "repeated")
    rows, _ = attach(rows, said, counts, said, "first", "first", counts, measure(counts, *said))
    part = F.expr(f"(row_number - 1) div {part_turns}")
    return workspace.save(_letters(rows).withColumn("part", part).drop("digest", "first"), "turns")


def _aligned_parts(turns: DataFrame, part_turns: int) -> DataFrame:
    """For each part its counts and its cheapest alignment between every two places (place before times 4 plus place after)."""
    gathered = turns.groupBy("key", "part").agg(
        F.sort_array(F.collect_list(F.struct("row_number", "letter", F.substring("role", 1, 1).alias("initial")))).alias("turns"),
        F.max("n").alias("n"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    listed = gathered.select(
        "key", "part", "n", "blank", "duplicate", "truncated", "turns.letter", "turns.initial"
    )
    types = StructType.fromDDL(
        "key string, part long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
        "costs array<long>, audits array<string>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, part, n, *counts, letters, initials in zip(*(c.to_pylist() for c in batch.columns)):
                is_last = part == (n - 1) // part_turns
                found = alignment.part("".join(letters), is_last)
                costs, audits = [_FAR] * 16, [None] * 16
                for (before, after), (cost, audit) in found.items():
                    costs[4 * before + after], audits[4 * before + after] = cost, audit
                yield key, part, n, *counts, _illegal(initials), initials[0], initials[-1], costs, audits

    return _over_sorted(listed, work, types)


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Parts from the last to the first: what all later ones cost from each place on."""
    key, behind = None, []
    for batch in batches:
        for name, part, costs in zip(*(c.to_pylist() for c in batch.columns)):
            if name != key:
                key, behind = name, [0 if place in (START, ASSISTANT) else _FAR for place in range(4)]
            yield name, part, behind
            behind = [min(costs[4 * i + j] + behind[j] for j in range(4)) for i in range(4)]


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Parts from the first to the last: place before, cost and audit of each, and whether its first turn may follow."""
    key, place, before = None, START, ""
    for batch in batches:
        for name, part, first, last, costs, audits, behind in zip(*(c.to_pylist() for c in batch.columns)):
            starts = name != key
            if starts:
                key, place = name, START
            least = min(costs[4 * place + j] + behind[j] for j in range(4))
            ends = [j for j in range(4) if costs[4 * place + j] + behind[j] == least]
            end = min(ends, key=lambda j: audits[4 * place + j])
            clash = 0 if starts else int((before, first) not in _LEGAL)
            yield name, part, place, costs[4 * place + end], audits[4 * place + end], clash
            place, before = end, last


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for (key, part), run in _grouped(batches, 2):
        place, audit = run[0][3], run[0][4]
        done = applied([(role, text) for _, role, text, *_ in run], audit, place)
        yield key, part, len(done), _lines(done), bool(done) and done[0][0][:1] == "s"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The digest of the parts' texts, taken in order; one part's text is held at a time."""
    key, digest, audit, lines, system = None, hashlib.sha256(), [], 0, False
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            name, count, text, edits, leads = (c[i].as_py() for c in columns)
            if name != key:
                if key is not None:
                    yield key, "".join(audit), system, digest.hexdigest()
                key, digest, audit, lines, system = name, hashlib.sha256(), [], 0, False
            if count and lines:
                digest.update(b"\n")
            if not lines:
                system = leads
            digest.update(text)
            lines += count
            audit.append(edits)
    if key is not None:
        yield key, "".join(audit), system, digest.hexdigest()


def _long(cut: DataFrame, long: DataFrame, workspace: Workspace, types: StructType, part_turns: int) -> DataFrame:
    turns = _numbered_turns(cut, workspace, part_turns)
    parts = workspace.save(_aligned_parts(turns, part_turns), "parts")
    at = ["key", "part"]
    backwards = parts.select("key", "part", "costs").repartition("key").sortWithinPartitions("key", F.col("part").desc())
    behind = _over_sorted(backwards, _costs_behind, StructType.fromDDL("key string, part long, behind array<long>"))
    forwards = parts.join(behind, at).select("key", "part", "first", "last", "costs", "audits", "behind")
    forwards = forwards.repartition("key").sortWithinPartitions(*at)
    chosen_types = StructType.fromDDL("key string, part long, place int, cost long, audit string, clash long")
    chosen = workspace.save(_over_sorted(forwards, _chosen, chosen_types), "chosen")

    with_edits = turns.join(chosen, at).select("key", "part", "row_number", "role", "text", "place", "audit")
    with_edits = with_edits.repartition(*at).sortWithinPartitions(*at, "row_number")
    text_types = StructType.fromDDL("key string, part long, lines long, text binary, leads boolean")
    texts = workspace.save(_over_sorted(with_edits, _texts, text_types), "texts")
    in_order = texts.join(chosen, at).select("key", "part", "lines", "text", "audit", "leads")
    in_order = in_order.repartition("key").sortWithinPartitions(*at).drop("part")
    digest_types = StructType.fromDDL("key string, audit string, system_first boolean, repaired_sha256 string")
    digests = _over_sorted(in_order, _digests, digest_types)

    sums = parts.join(chosen.select(*at, "cost", "clash"), at).groupBy("key").agg(
        F.max("n").alias("n_turns"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")],
        F.sum(F.col("illegal") + F.col("clash")).alias("illegal"),
    )
    spans = turns.groupBy("key").agg(
        F.min("turn").alias("least"), F.max("turn").alias("greatest"), F.count_distinct("turn").alias("distinct")
    )
    # In decimals, then modulo 2^64, as a span may exceed a long.
    span = (F.col("greatest").cast("decimal(21,0)") - F.col("least") + 1 - F.col("distinct")).cast("decimal(21,0)")
    half, whole = F.lit(str(1 << 63)).cast("decimal(21,0)"), F.lit(str(1 << 64)).cast("decimal(21,0)")
    gaps = F.coalesce((F.pmod(span + half, whole) - half).cast("long"), F.lit(0).cast("long"))
    found = sums.join(spans.select("key", gaps.alias("gaps")), "key").join(digests, "key")
    return long.select("key", F.col("long_id").alias("conv_id")).join(found, "key").select(*types.names)


# -- the repaired turns ----------------------------------------------------------------------------------------------


def repaired_turns(conversations: DataFrame, repairs: DataFrame, workspace: Workspace) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns that ``repairs`` (of ``repaired``) leave, numbered from 1 in each conversation.

    Takes the same ``conversations``; groups of any size are numbered across tasks.
    """
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    blank = F.lit(" ")
    rows = conversations.where(F.coalesce(present, F.lit(False))).select(
        _key(F.col("conv_id")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    rows = numbered(rows, ["key"], _order(), workspace).select("key", "row_number", "role", "text")
    edits = repairs.where("audit <> ''").select(
        "conv_id",
        _key(F.col("conv_id")).alias("key"),
        "system_first",
        F.posexplode(F.split("audit", "")).alias("at", "edit"),
    )
    edits = workspace.save(edits.where("edit <> ''"), "edits")
    taken = numbered(edits.where("edit <> 'I'"), ["key"], [F.col("at")], workspace)
    taken = taken.select("key", "at", F.col("row_number").alias("number"))
    placed = numbered(edits.where("edit <> 'D'"), ["key"], [F.col("at")], workspace)
    placed = placed.withColumnRenamed("row_number", "place").join(taken, ["key", "at"], "left")
    found = placed.join(rows.withColumnRenamed("row_number", "number"), ["key", "number"], "left")
    is_user = (F.col("place") - F.col("system_first").cast("long")) % 2 == 1
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.when(is_user, "user").otherwise("assistant"))
    return found.select(
        "conv_id", "place", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
