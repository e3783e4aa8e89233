import pytest
from pyspark.sql import functions as F

from pseudospark import MappingStore
from pseudospark.operators import checks
from pseudospark.sources import files
from pseudospark.suite.common import namespaces


def requests(spark, *pairs):
    return spark.createDataFrame(list(pairs), "namespace_name string, original_value string")


def as_dict(df):
    rows = df.collect()
    found = {(r.namespace_name, r.original_value): r.pseudonym_value for r in rows}
    assert len(found) == len(rows)
    return found


def test_batch_with_repeats_and_two_namespaces(spark, store, catalog):
    asked = requests(spark, ("A", "value1"), ("B", "value1"), ("A", "value1"), ("A", "value2"))
    done = store.upsert(asked, catalog)
    first = as_dict(done.mappings)
    assert set(first) == {("A", "value1"), ("B", "value1"), ("A", "value2")}
    assert first["A", "value1"] != first["B", "value1"]
    assert (done.requested, done.created, done.cells) == (3, 3, 4)
    again = store.upsert(requests(spark, ("A", "value1"), ("A", "value3")), catalog)
    assert as_dict(again.mappings)["A", "value1"] == first["A", "value1"]
    assert again.created == 1
    assert store.read().count() == 4


def test_same_value_three_times_is_one_row(spark, store, catalog):
    seen = {as_dict(store.upsert(requests(spark, ("ns", "x")), catalog).mappings)["ns", "x"] for _ in range(3)}
    assert len(seen) == 1
    assert store.read().count() == 1


def test_existing_pseudonym_is_never_replaced(spark, store, catalog):
    seeded = spark.sql(
        "SELECT 'existingNamespace' namespace_name, 'an original value' original_value,"
        " 'existingPseudonym' pseudonym_value, timestamp'2024-01-01' created_at, timestamp'2024-01-01' last_updated_at"
    )
    store.seed(seeded, "seed")
    done = store.upsert(requests(spark, ("existingNamespace", "an original value")), catalog)
    assert as_dict(done.mappings) == {("existingNamespace", "an original value"): "existingPseudonym"}
    later = seeded.withColumn("pseudonym_value", F.lit("other"))
    store.seed(later, "seed 2")
    assert store.read().first().pseudonym_value == "existingPseudonym"


def test_affixes_do_not_count_in_the_length(spark, store, catalog):
    value = as_dict(store.upsert(requests(spark, ("emptyNamespace", "x")), catalog).mappings)["emptyNamespace", "x"]
    assert value.startswith("pre-") and value.endswith("-suf") and len(value) == 54 + 8


@pytest.mark.parametrize("blank", ["", "   ", " \t"])
def test_blank_originals_are_rejected(spark, store, catalog, blank):
    with pytest.raises(ValueError, match="Blank"):
        store.upsert(requests(spark, ("A", "x"), ("A", blank)), catalog)
    assert store.read().count() == 0


def test_null_originals_are_rejected(spark, store, catalog):
    with pytest.raises(ValueError, match="Blank"):
        store.upsert(requests(spark, ("A", None)), catalog)


def test_unknown_namespace_fails_before_anything_is_stored(spark, store, catalog):
    with pytest.raises(ValueError, match="^1 values are in namespaces that do not exist"):
        store.upsert(requests(spark, ("A", "x"), ("nowhere", "x")), catalog)
    assert store.read().count() == 0


def test_retried_batch_changes_nothing(spark, store, catalog):
    asked = requests(spark, *[("A", str(i)) for i in range(50)])
    first = as_dict(store.upsert(asked, catalog, "batch 7/x").mappings)
    retry = store.upsert(asked, catalog, "batch 7/x")
    assert as_dict(retry.mappings) == first
    assert retry.created == 0
    # Other keys under the same id are another commit.
    assert store.upsert(requests(spark, ("A", "new")), catalog, "batch 7/x").created == 1
    assert store.read().count() == 51


def test_seeding_again_adds_what_is_missing(spark, store):
    columns = "namespace_name string, original_value string, pseudonym_value string, created_at timestamp, last_updated_at timestamp"
    rows = [("A", v, f"p{v}", None, None) for v in "abc"]
    store.seed(spark.createDataFrame(rows[:2], columns), "seed")
    store.seed(spark.createDataFrame(rows, columns), "seed")
    store.seed(spark.createDataFrame(rows, columns), "seed")
    assert sorted(r.original_value for r in store.read().collect()) == ["a", "b", "c"]


def test_streams_see_no_unpublished_batch(spark, store, catalog):
    store.upsert(requests(spark, ("A", "x")), catalog, "one")
    staged = f"{store.path}/_staged/left-behind"
    store.read().write.partitionBy("namespace_name").parquet(staged)
    query = store.stream().writeStream.format("memory").queryName("published").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("published").count() == 1


def test_lengths_and_methods_of_other_namespaces_do_not_matter(spark, store):
    catalog = namespaces(spark, fine=("Uuid4", 36), short=("Uuid4", 12), hashed=("Sha256HexEncoded", 10), odd=("NoSuchMethod", 8))
    assert store.upsert(requests(spark, ("fine", "x")), catalog).created == 1
    for name in ("short", "hashed"):
        with pytest.raises(ValueError, match="^1 values are in namespaces with a length"):
            store.upsert(requests(spark, ("fine", "y"), (name, "x")), catalog)
    assert store.read().count() == 1


def test_unfinished_batch_is_invisible_and_replaced(spark, store, catalog):
    asked = requests(spark, ("A", "x"), ("A", "y"))
    store.upsert(asked, catalog, "one")
    files.delete(spark, files.glob(spark, f"{store.path}/*/batch_id=one/_SUCCESS")[0])
    assert store.read().count() == 0
    assert as_dict(store.upsert(asked, catalog, "one").mappings) == as_dict(store.read())
    assert store.read().count() == 2


def test_namespace_names_are_free_text(spark, store):
    names = ["001", "1", "a/b=c", "x y", "ü%20", "NULL", "*", "{a}"]
    catalog = namespaces(spark, **{n: ("Uuid4", 36) for n in names})
    store.upsert(requests(spark, *[(n, "v") for n in names]), catalog)
    assert {r[0] for r in store.read().select("namespace_name").collect()} == set(names)
    for name in ("001", "a/b=c", "*"):
        store.delete_namespace(name)
    assert {r[0] for r in store.read().select("namespace_name").collect()} == set(names) - {"001", "a/b=c", "*"}
    assert store.read(["1"]).count() == 1


def test_two_writers_are_detected_and_the_earlier_wins(spark, store, catalog, workspace):
    """Writers that did not see each other both stored a pseudonym."""
    one = store.upsert(requests(spark, ("A", "x")), catalog, "one")
    first = as_dict(one.mappings)["A", "x"]
    other = MappingStore(spark, workspace.path("other"), workspace)
    other.upsert(requests(spark, ("A", "x")), catalog, "two")
    source = files.glob(spark, f"{other.path}/*/batch_id=two")[0]
    files.rename(spark, source, f"{files.glob(spark, store.path + '/generation=*')[0]}/batch_id=two")
    assert checks.duplicate_keys(store.read()).count() == 1
    assert as_dict(store.upsert(requests(spark, ("A", "x")), catalog).mappings)["A", "x"] == first
    store.compact()
    assert as_dict(store.read()) == {("A", "x"): first}


def test_compaction_keeps_everything(spark, store, catalog):
    for i in range(3):
        store.upsert(requests(spark, *[("A", str(i + j)) for j in range(4)]), catalog, f"b{i}")
    before = as_dict(store.read())
    store.compact()
    assert as_dict(store.read()) == before
    assert len(files.glob(spark, f"{store.path}/generation=*")) == 2
    store.drop_superseded()
    assert len(files.glob(spark, f"{store.path}/generation=*")) == 1
    store.upsert(requests(spark, ("A", "new")), catalog)
    assert as_dict(store.read()).items() >= before.items()


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_large_and_small_requests_agree(spark, workspace, catalog, limit):
    store = MappingStore(spark, workspace.path("store"), workspace, broadcast_bytes=limit)
    first = as_dict(store.upsert(requests(spark, *[("A", str(i)) for i in range(100)]), catalog).mappings)
    asked = requests(spark, *[("A", str(i)) for i in range(50, 150)], *[("B", str(i)) for i in range(20)])
    done = store.upsert(asked, catalog)
    second = as_dict(done.mappings)
    assert len(second) == 120 and done.created == 70
    assert all(second["A", str(i)] == first["A", str(i)] for i in range(50, 100))


def test_hot_namespace_is_written_by_many_tasks(spark, workspace):
    """The rebalance splits a namespace that holds nearly all keys."""
    catalog = namespaces(spark, hot=("Uuid4", 36), cold=("Uuid4", 36))
    store = MappingStore(spark, workspace.path("store"), workspace)
    asked = spark.range(50000).select(
        F.when(F.col("id") < 10, "cold").otherwise("hot").alias("namespace_name"),
        F.sha2(F.col("id").cast("string"), 512).alias("original_value"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        done = store.upsert(asked, catalog)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert done.created == 50000
    assert len(files.glob(spark, f"{store.path}/*/*/namespace_name=hot/*.parquet")) > 1


def test_checks(spark, catalog):
    rows = [("A", "a1", "p"), ("A", "a1", "p"), ("A", "a2", "p"), ("B", "b1", "p"), ("Z", "z", None)]
    df = spark.createDataFrame(rows, "namespace_name string, original_value string, pseudonym_value string")
    assert [tuple(r) for r in checks.duplicate_keys(df).collect()] == [("A", "a1", 2)]
    assert [tuple(r) for r in checks.ambiguous_pseudonyms(df).collect()] == [("A", "p")]
    assert [r.original_value for r in checks.orphans(df, catalog).collect()] == ["z"]
    nulls = checks.null_counts(df, ["original_value", "pseudonym_value"]).first()
    assert tuple(nulls) == (0, 1)


def test_stream_counts_follow_commits(spark, store, catalog, workspace):
    from pseudospark.streaming.microbatch import stream_counts

    snapshots, checkpoint = workspace.path("snapshots"), workspace.path("checkpoint")
    for i in range(2):
        store.upsert(requests(spark, *[("A", f"{i}-{j}") for j in range(5)], ("B", str(i))), catalog, str(i))
        stream_counts(store, snapshots, checkpoint, "counts").awaitTermination()
    newest = spark.read.parquet(f"{snapshots}/batch_id=1")
    assert {r.namespace_name: r.n for r in newest.collect()} == {"A": 10, "B": 2}
    store.delete_namespace("A")
    store.compact()
    store.drop_superseded()
    store.upsert(requests(spark, ("A", "again")), catalog)
    stream_counts(store, snapshots, checkpoint, "counts").awaitTermination()
    newest = spark.read.parquet(f"{snapshots}/batch_id=2")
    assert {r.namespace_name: r.n for r in newest.collect()} == {"A": 1, "B": 2}


def test_stored_tables_are_compressed(spark, store, workspace):
    """Digests are half as large in the files as they are as text, in the store and in intermediate tables."""
    ids = spark.range(30_000).withColumn("digest", F.upper(F.sha2(F.col("id").cast("string"), 256)))
    path = workspace.save(ids, "digests").inputFiles()[0].rsplit("/", 1)[0]
    assert files.size(spark, path) < 30_000 * 48
    rows = ids.selectExpr(
        "'A' namespace_name", "string(id) original_value", "digest pseudonym_value", "current_timestamp() created_at",
        "current_timestamp() last_updated_at",
    )
    store.seed(rows, "seeded")
    assert all(".zstd." in f for f in store.read().inputFiles())
    assert store.read().where("pseudonym_value = upper(sha2(original_value, 256))").count() == 30_000
