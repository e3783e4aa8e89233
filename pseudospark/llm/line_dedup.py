"""Line dedup over overlapping windows of three lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudospark.operators.resolve import BROADCAST_BYTES
from pseudospark.sources.files import Workspace

WINDOW = 3
#: 64-bit hashes of a window, two of them; windows agree if both do.
_HASHES = ("window", "check")
#: A broadcast row's size besides its places.
COVERED_ROW_BYTES = 64


def _hashed_windows(lines: Column) -> Column:
    """An array with one struct per window of consecutive lines: its first line's place and two hashes."""

    def window(place: Column) -> Column:
        own = [F.element_at(lines, (place + 1 + i).cast("int")) for i in range(WINDOW)]
        return F.struct(
            place.cast("int").alias("place"),
            F.xxhash64(*own).alias("window"),
            F.xxhash64(F.lit("check"), *reversed(own)).alias("check"),
            (F.trim(F.concat(*own)) != "").alias("written"),
        )

    places = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, window)


def without_repeated_lines(
    docs: DataFrame,
    workspace: Workspace,
    *,
    id: str = "doc_id",
    text: str = "text",
    names: tuple[str, str, str] = ("line_count", "removed_lines", "deduplicated"),
) -> DataFrame:
    """``docs`` with three new columns: number of lines, places of removed lines (sorted), and the text without them.

    Lines are parts between line feeds, as they are. Wherever the same three consecutive lines, not all of them blank,
    occur more than once, over all texts and within one, the occurrence with the smallest id (then digest of the text,
    then place) stays, and all lines of every later one are removed; covered places are merged, so a line goes once.
    Texts of fewer than three lines are left as they are; a null text stays null and has no lines; a text of which every
    line goes is empty. Rows that repeat id and text are one document: their lines are compared with others, not with
    each other. A null id counts as smaller than any other. Other columns pass through, whatever their names;
    ``names`` are those of the new columns, which must be no columns of ``docs``. An empty table gives no rows.
    """
    clashing = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if clashing:
        raise ValueError(f"give the new columns other names than {sorted(clashing)}")
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    # The caller's columns travel in a struct, so that no name of theirs meets one of these.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    digest = F.xxhash64(F.col(text)).alias("__digest")
    source = docs.select(row, F.col(id).alias("__doc"), digest, lines.alias("__lines"))
    keyed = source.where(F.size("__lines") >= WINDOW).select("__doc", "__digest", "__lines")
    found = keyed.select("__doc", "__digest", F.explode(_hashed_windows(F.col("__lines"))).alias("at"))
    windows = found.where("at.written").select("__doc", "__digest", "at.place", "at.window", "at.check")
    order = F.struct(F.col("__doc"), F.col("__digest"), F.col("place"))
    least = windows.groupBy(*_HASHES).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    repeated = workspace.save(least.where("first <> last").select(*_HASHES, "first"), "repeated")
    # Both sides of this join are plain tables, so that a window that much of the corpus shares is split over tasks.
    later = windows.join(repeated, list(_HASHES)).where(order != F.col("first"))
    covered = later.groupBy("__doc", "__digest").agg(F.collect_set("place").alias("places"))
    covered = workspace.save(
        covered.select(
            F.col("__doc").alias("__covered_doc"),
            F.col("__digest").alias("__covered_digest"),
            F.sort_array(
                F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + WINDOW - 1))))
            ).alias("__places"),
        ),
        "covered",
    )
    # Texts are moved to their places only if there are too many places for every task to have them all.
    size = covered.select(F.coalesce(F.sum(F.size("__places") * 4 + COVERED_ROW_BYTES), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        covered = F.broadcast(covered)
    same = F.col("__doc").eqNullSafe(F.col("__covered_doc")) & (F.col("__digest") == F.col("__covered_digest"))
    joined = source.join(covered, same, "left")
    marked = joined.withColumn("__gone", F.coalesce("__places", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("__lines", i + 1)), "\n")
    done = marked.select(
        "__row",
        F.greatest(F.size("__lines"), F.lit(0)).alias("__count"),
        "__gone",
        F.when(F.size("__gone") == 0, F.col("__row").getField(text).cast("string")).otherwise(kept).alias("__kept"),
    )
    # Only here do the caller's names come back, when no expression looks for one of these inside a lambda.
    return done.select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns],
        F.col("__count").alias(names[0]),
        F.col("__gone").alias(names[1]),
        F.col("__kept").alias(names[2]),
    )
