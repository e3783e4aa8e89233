import pytest
from pyspark.sql import functions as F

from pseudospark import ColumnMapping, pseudonymize
from pseudospark.operators import resolve
from pseudospark.sources import files


@pytest.fixture
def unadapted(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def attached(spark, workspace, key, limit):
    """20,000 rows in eight tasks, joined by shuffle; the largest share that one task got."""
    df = spark.range(0, 20000, 1, 8).select(key.alias("key"))
    mapping = spark.range(3000).select(
        F.col("id").cast("string").alias("k"), F.concat(F.lit("p"), F.col("id")).alias("v")
    )
    counts = workspace.save(df.where("key IS NOT NULL").groupBy(F.col("key").alias("k")).count(), "counts")
    counts = counts.withColumnRenamed("count", "n")
    joined, in_order = resolve.attach(df, ["key"], mapping, ["k"], "v", "found", counts, 1 << 40, limit)
    assert not in_order
    wrong = F.count(F.when(~F.col("found").eqNullSafe(F.concat(F.lit("p"), F.col("key"))), 1))
    whole = joined.agg(F.count("*").alias("n"), wrong.alias("wrong")).first()
    assert tuple(whole) == (20000, 0)
    sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    return max(row["count"] for row in sizes) / 20000


@pytest.mark.parametrize("limit", [0, 4096])
def test_rows_without_a_value_spread(spark, workspace, unadapted, limit):
    assert attached(spark, workspace, F.lit(None).cast("string"), limit) < 0.7


@pytest.mark.parametrize("limit", [0, 4096])
def test_rows_of_a_hot_key_spread(spark, workspace, unadapted, limit):
    """A third of all rows under one key: broadcast where its value fits, split into parts where it does not."""
    hot = F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") % 3000).cast("string"))
    assert attached(spark, workspace, hot, limit) < 0.6


def test_scratch_goes_on_release_and_on_failure(spark, store, catalog):
    df = spark.createDataFrame([("x",), ("y",)], "value string")

    def left():
        return files.glob(spark, f"{store.workspace.root}/pseudospark-*/*")

    result = pseudonymize(df, [ColumnMapping("value", "A")], catalog, store)
    assert left() and result.df.count() == 2
    result.release()
    assert not left()
    blank = spark.createDataFrame([("x", "A"), ("y", "nowhere")], "value string, ns string")
    with pytest.raises(ValueError):
        pseudonymize(blank, [ColumnMapping("value", namespace_column="ns")], catalog, store)
    assert not left()


@pytest.mark.parametrize("partitions", [8, 40])
def test_hot_keys_split_in_proportion(spark, workspace, unadapted, partitions):
    """One key in half of all rows, beside many long ones that are hot as well: all but the key's rows stay where they are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        long_key = F.concat(F.repeat(F.lit("x"), 5000), (F.col("id") % 400).cast("string"))
        df = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(long_key).alias("key"))
        mapping = workspace.save(df.distinct().select(F.col("key").alias("k"), F.md5("key").alias("v")), "mapping")
        counts = workspace.save(df.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")), "counts")
        # The long keys alone are too large for a broadcast of theirs.
        joined, _ = resolve.attach(df, ["key"], mapping, ["k"], "v", "found", counts, 1 << 40, 0)
        joined = workspace.save(joined.withColumn("task", F.spark_partition_id()), "joined")
        assert joined.where("found = md5(key)").count() == joined.count() == 20000
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
        assert max(sizes) < 20000 * (0.45 if partitions == 8 else 0.2)
        parts = {r.n for r in resolve._parts(counts, ["k"]).agg(F.max("__parts").alias("n")).collect()}
        assert parts == {partitions // 2 + 1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
