"""Ordered work over groups of any size.

A window over one key runs in one task. Here the rows are range-partitioned by (group, order), so a large group covers
many slices; each slice is worked on by itself and only one summary row per (group, slice) is carried along the group.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pseudospark.operators.resolve import broadcast_if_small
from pseudospark.sources.files import Workspace

SLICE = "__slice"
POSITION = "__position"
_POSITION_BITS = 33  # how monotonically_increasing_id packs partition and row number


def sliced(df: DataFrame, group: list[str], order: list[Column], workspace: Workspace) -> DataFrame:
    """``df`` with its slice number and the position inside the slice, stored in sorted order.

    ``order`` should end in a unique column; rows equal in group and order share a slice.
    """
    keys = [F.col(g) for g in group] + order
    ranked = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn(SLICE, F.shiftright("__id", _POSITION_BITS))
        .withColumn(POSITION, F.col("__id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("__id")
    )
    return workspace.save(ranked, "sliced")


def in_slice(group: list[str]):
    """Window over one group's rows of one slice."""
    return Window.partitionBy(*group, SLICE).orderBy(POSITION)


def along_group(group: list[str]):
    """Window over one group's slice summaries; as many rows as the group has slices."""
    return Window.partitionBy(*group).orderBy(SLICE)


def with_summary(rows: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    """Join slice summaries back to their rows."""
    return rows.join(broadcast_if_small(summary, *group), [*group, SLICE], "left")


def numbered(df: DataFrame, group: list[str], order: list[Column], workspace: Workspace) -> DataFrame:
    """Add ``row_number``: 1, 2, ... inside each group."""
    rows = sliced(df, group, order, workspace)
    before = along_group(group).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        rows.groupBy(*group, SLICE)
        .agg(F.min(POSITION).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    number = F.col(POSITION) - F.col("__first") + F.col("__before") + 1
    return with_summary(rows, summary, group).withColumn("row_number", number).drop(
        SLICE, POSITION, "__first", "__before"
    )
