"""Reading the store: pages, counts and reverse lookup."""

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pseudospark.operators.ordered import numbered
from pseudospark.operators.resolve import broadcast_if_small
from pseudospark.operators.store import EPOCH, MappingStore, first_reverse
from pseudospark.schemas import PSEUDONYM_COLUMNS, PSEUDONYM_SCHEMA
from pseudospark.sources.files import Workspace

DEFAULT_PAGE_SIZE = 25


@dataclass(frozen=True)
class Cursor:
    """Where a page ended. It holds an original value, so it stays on the driver and never becomes a column."""

    created_at: datetime
    original_value: str


@dataclass(frozen=True)
class Page:
    items: DataFrame
    next_cursor: Cursor | None
    total: int | None = None


def effective_page_size(size: int) -> int:
    return DEFAULT_PAGE_SIZE if size <= 0 else size


def summary(mappings: DataFrame) -> DataFrame:
    """What a listing shows: never the original value."""
    return mappings.select(
        "namespace_name",
        F.col("pseudonym_value").alias("pseudonym"),
        "created_at",
        "last_updated_at",
    )


def _after(cursor: Cursor) -> Column:
    created = F.lit(cursor.created_at)
    return (F.col("created_at") < created) | (
        (F.col("created_at") == created) & (F.col("original_value") < F.lit(cursor.original_value))
    )


def page_rows(mappings: DataFrame, namespace: str, cursor: Cursor | None = None, size: int = 0) -> DataFrame:
    """One page, newest first: a pruned scan and a top-n, no offset to skip over."""
    rows = mappings.where(F.col("namespace_name") == namespace)
    if cursor is not None:
        rows = rows.where(_after(cursor))
    newest = [F.col("created_at").desc(), F.col("original_value").desc()]
    return rows.orderBy(*newest).limit(effective_page_size(size))


def next_cursor(rows: DataFrame, size: int = 0) -> Cursor | None:
    """The cursor behind a page, if the page is full. Only its last row reaches the driver."""
    last = F.min(F.struct("created_at", "original_value"))  # newest first
    found = rows.agg(F.count(F.lit(1)).alias("n"), last.alias("last")).first()
    if found["n"] < effective_page_size(size):
        return None
    return Cursor(found["last"]["created_at"], found["last"]["original_value"])


def page(
    mappings: DataFrame,
    namespace: str,
    cursor: Cursor | None = None,
    size: int = 0,
    with_total: bool = False,
) -> Page:
    rows = page_rows(mappings, namespace, cursor, size)
    total = count_one(mappings, namespace).first()["n"] if with_total else None
    return Page(summary(rows), next_cursor(rows, size), total)


def stored_page(
    store: MappingStore,
    namespace: str,
    cursor: Cursor | None = None,
    size: int = 0,
    with_total: bool = False,
) -> Page:
    """As ``page``, by the times of the store's batches: the newest are read first, each reading four times as many as the
    one before, until no batch left can hold a row of the page. Items and cursor come of the same reading; a page's rows
    are on the driver while it is put together."""
    wanted = effective_page_size(size)
    left = store.batches(namespace)
    if cursor is not None:
        before = (cursor.created_at.astimezone(EPOCH.tzinfo) - EPOCH) // timedelta(microseconds=1)
        left = [b for b in left if b.least is not None and b.least <= before]
    rows: list[tuple] = []
    step = 1
    while left:
        if len(rows) == wanted:
            oldest = rows[-1][0]
            left = [b for b in left if oldest is None or b.greatest is not None and b.greatest >= oldest]
        some, left = left[:step], left[step:]
        if some:
            found = page_rows(store.read_batches(some, namespace), namespace, cursor, size)
            found = found.select(F.unix_micros("created_at").alias("at"), *PSEUDONYM_COLUMNS).collect()
            rows = sorted([*rows, *map(tuple, found)], key=_newest_first, reverse=True)[:wanted]
        step *= 4
    names = ["at", *PSEUDONYM_COLUMNS]
    items = [dict(zip(names, row)) for row in rows]
    schema = StructType([PSEUDONYM_SCHEMA[c] for c in PSEUDONYM_COLUMNS])
    frame = store.spark.createDataFrame([row[1:] for row in rows], schema)
    last = Cursor(items[-1]["created_at"], items[-1]["original_value"]) if len(items) == wanted else None
    total = count_one(store.read([namespace]), namespace).first()["n"] if with_total else None
    return Page(summary(frame), last, total)


def _newest_first(row: tuple) -> tuple:
    at, original = row[0], row[1 + PSEUDONYM_COLUMNS.index("original_value")]
    return at is not None, at or 0, original.encode()


def page_sweep(mappings: DataFrame, size: int, workspace: Workspace) -> DataFrame:
    """Every mapping with the number of the page that shows it, all namespaces at once."""
    order = [F.col("created_at").desc(), F.col("original_value").desc()]
    counted = numbered(mappings, ["namespace_name"], order, workspace)
    number = F.ceil(F.col("row_number") / F.lit(effective_page_size(size))).cast("long")
    return summary_with_page(counted.withColumn("page", number))


def summary_with_page(rows: DataFrame) -> DataFrame:
    return rows.select(
        "namespace_name",
        F.col("pseudonym_value").alias("pseudonym"),
        "created_at",
        "last_updated_at",
        "row_number",
        "page",
    )


def count_one(mappings: DataFrame, namespace: str) -> DataFrame:
    return mappings.where(F.col("namespace_name") == namespace).agg(F.count(F.lit(1)).alias("n"))


def count_by_namespace(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("namespace_name").agg(F.count(F.lit(1)).alias("n"))


def reverse_one(mappings: DataFrame, namespace: str, pseudonym: str) -> DataFrame:
    """The mapping behind one pseudonym, or no row. Both conditions reach the scan."""
    return (
        mappings.where((F.col("namespace_name") == namespace) & (F.col("pseudonym_value") == pseudonym))
        .orderBy("created_at", "original_value")
        .limit(1)
    )


def reverse_many(mappings: DataFrame, requests: DataFrame) -> DataFrame:
    """The first mapping behind every requested (namespace, pseudonym); unknown ones are absent."""
    keys = ["namespace_name", "pseudonym_value"]
    wanted = broadcast_if_small(requests.select(*keys).distinct(), *keys)
    return first_reverse(mappings.join(wanted, keys, "left_semi"))
