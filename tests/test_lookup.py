import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pseudospark.operators import lookup
from pseudospark.operators.ordered import numbered


@pytest.fixture(scope="module")
def mappings(spark):
    """99 rows of one namespace, many of them created at the same time, and some of another."""
    times = spark.range(99).select(
        F.lit("paged").alias("namespace_name"),
        F.concat(F.lit("original "), F.col("id")).alias("original_value"),
        F.concat(F.lit("p"), F.col("id")).alias("pseudonym_value"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.floor(F.col("id") / 10))).alias("created_at"),
    )
    other = times.limit(7).withColumn("namespace_name", F.lit("other"))
    return times.unionByName(other).withColumn("last_updated_at", F.col("created_at"))


def test_following_cursors_shows_every_row_once(mappings):
    seen, cursor, sizes = [], None, []
    while True:
        page = lookup.page(mappings, "paged", cursor, 5, with_total=True)
        items = [r.pseudonym for r in page.items.collect()]
        seen += items
        sizes.append(len(items))
        assert page.total == 99
        assert page.items.columns == ["namespace_name", "pseudonym", "created_at", "last_updated_at"]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert len(seen) == len(set(seen)) == 99
    assert sizes == [5] * 19 + [4]


def test_pages_are_newest_first(mappings):
    rows = lookup.page_rows(mappings, "paged", size=99).collect()
    keys = [(r.created_at, r.original_value) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_default_size_and_full_last_page(mappings):
    assert lookup.page_rows(mappings, "paged").count() == 25
    assert lookup.page_rows(mappings, "paged", size=-3).count() == 25
    rows = lookup.page_rows(mappings, "paged", size=99)
    cursor = lookup.next_cursor(rows, 99)
    assert cursor is not None and lookup.page_rows(mappings, "paged", cursor, 99).count() == 0
    assert lookup.page(mappings, "nowhere").next_cursor is None
    assert lookup.page(mappings, "paged").total is None


def test_counts(mappings):
    assert {r.namespace_name: r.n for r in lookup.count_by_namespace(mappings).collect()} == {"paged": 99, "other": 7}
    assert lookup.count_one(mappings, "nowhere").first().n == 0


def test_reverse(mappings):
    assert lookup.reverse_one(mappings, "paged", "p3").first().original_value == "original 3"
    assert lookup.reverse_one(mappings, "nowhere", "p3").count() == 0
    asked = mappings.sparkSession.createDataFrame(
        [("paged", "p3"), ("paged", "p3"), ("other", "p90")], "namespace_name string, pseudonym_value string"
    )
    assert [r.original_value for r in lookup.reverse_many(mappings, asked).collect()] == ["original 3"]


def test_sweep_agrees_with_the_pages(mappings, workspace):
    swept = lookup.page_sweep(mappings, 10, workspace)
    third = [r.pseudonym for r in swept.where("namespace_name = 'paged' AND page = 3").orderBy("row_number").collect()]
    rows = lookup.page_rows(mappings, "paged", size=99).collect()
    assert third == [r.pseudonym_value for r in rows[20:30]]


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_numbering_of_a_group_that_spans_slices(spark, workspace, partitions):
    rng = random.Random(5)
    data = [(rng.choice(["big"] * 8 + ["a", "b"]), rng.randint(0, 60), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o int, i int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, ["g"], [F.col("o").desc(), F.col("i")], workspace).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for group in ("big", "a", "b"):
        ordered = sorted((row for row in data if row[0] == group), key=lambda r: (-r[1], r[2]))
        expected.update({row[2]: n for n, row in enumerate(ordered, 1)})
    assert {r.i: r.row_number for r in got} == expected and len(got) == len(data)


def test_cursor_with_a_time_of_its_own(mappings):
    cursor = lookup.Cursor(datetime(2024, 1, 1, 0, 0, 0), "original 5")
    rows = [r.original_value for r in lookup.page_rows(mappings, "paged", cursor, 50).collect()]
    assert rows == ["original 4", "original 3", "original 2", "original 1", "original 0"]
