import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pseudospark import ColumnMapping
from pseudospark.plans.job_run import LEDGER_SCHEMA, JobLedger
from pseudospark.sources import files
from pseudospark.streaming.microbatch import (
    progress_snapshots,
    stream_counts,
    stream_depseudonymize,
    stream_pseudonymize,
)
from pseudospark.streaming.supervision import silent_jobs, stream_stalled

SCHEMA = "id long, value string"


@pytest.fixture
def folders(workspace):
    names = "arrivals output progress checkpoint back back_progress back_checkpoint".split()
    return {n: workspace.path(n) for n in names}


def arrive(spark, folders, start, count, files=2):
    rows = spark.range(start, start + count).select(
        "id", F.when(F.col("id") % 5 == 0, "NA").otherwise(F.concat(F.lit("v"), F.col("id") % 17)).alias("value")
    )
    rows.repartition(files).write.mode("append").parquet(folders["arrivals"])


def run(spark, folders, store, catalog):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folders["arrivals"])
    mapped = [ColumnMapping("value", "ns")]
    query = stream_pseudonymize(
        source, mapped, catalog, store, folders["output"], folders["progress"], folders["checkpoint"], "feed"
    )
    query.awaitTermination()


def test_stream_there_and_back(spark, store, catalog, folders):
    arrive(spark, folders, 0, 60)
    run(spark, folders, store, catalog)
    arrive(spark, folders, 60, 25, files=1)  # what is left over is drained too
    run(spark, folders, store, catalog)

    hidden = {r.id: r.value for r in spark.read.parquet(folders["output"]).collect()}
    assert set(hidden) == set(range(85))
    assert all(v == "NA" for i, v in hidden.items() if i % 5 == 0)
    same = {(i % 17, v) for i, v in hidden.items() if i % 5}
    assert len(same) == len({v for _, v in same}) == 17 == store.read().count()

    snapshots = progress_snapshots(spark.read.parquet(folders["progress"])).orderBy("batch_id").collect()
    assert len(snapshots) == 3
    assert (snapshots[-1].rows_processed, snapshots[-1].missing_value_count) == (85, 17)
    assert [s.rows_processed for s in snapshots] == sorted(s.rows_processed for s in snapshots)

    source = spark.readStream.schema("id long, value string").parquet(folders["output"] + "/*")
    stream_depseudonymize(
        source, [ColumnMapping("value", "ns")], catalog, store,
        folders["back"], folders["back_progress"], folders["back_checkpoint"], "back",
    ).awaitTermination()
    shown = {r.id: r.value for r in spark.read.parquet(folders["back"]).collect()}
    assert shown == {i: "NA" if i % 5 == 0 else f"v{i % 17}" for i in range(85)}
    # Nothing in the clear stays behind.
    assert not [f for f in files.glob(spark, f"{store.workspace.root}/pseudospark-*/*") if f]


def test_replayed_batch_changes_nothing(spark, store, catalog, folders, workspace):
    """A second checkpoint makes the query run its batches again from the start, under the same name."""
    arrive(spark, folders, 0, 40, files=1)
    run(spark, folders, store, catalog)
    first = {r.id: r.value for r in spark.read.parquet(folders["output"]).collect()}
    run(spark, {**folders, "checkpoint": workspace.path("checkpoint")}, store, catalog)
    again = {r.id: r.value for r in spark.read.parquet(folders["output"]).collect()}
    assert again == first and store.read().count() == 17


def test_counts_follow_every_change(spark, store, catalog, workspace):
    """Sums of changes equal the stored rows after batches, a deletion, a compaction and a writer stopped half-way."""
    snapshots, checkpoint = workspace.path("snapshots"), workspace.path("checkpoint")

    def counted():
        stream_counts(store, snapshots, checkpoint, "counts").awaitTermination()
        batches = spark.read.parquet(snapshots)
        newest = batches.agg(F.max("batch_id")).first()[0]
        return {r.namespace_name: r.n for r in batches.where(F.col("batch_id") == newest).collect()}

    def stored():
        return {r.namespace_name: r["count"] for r in store.read().groupBy("namespace_name").count().collect()}

    def create(space, *values):
        rows = spark.createDataFrame([(space, v) for v in values], "namespace_name string, original_value string")
        store.upsert(rows, catalog)

    create("A", "x", "y")
    create("B", "x")
    create("A", "y", "z")
    assert counted() == stored() == {"A": 3, "B": 1}
    # The same key twice, as two writers at a time leave it; compaction keeps one.
    twice = store.read(["A"]).where("original_value = 'x'")
    store._write(f"{store.path}/{store._generation()}/batch_id=second", twice)
    assert counted() == {"A": 4, "B": 1}
    store.delete_namespace("B")
    store.compact()
    assert counted() == stored() == {"A": 3}
    # A change that was written down before its batch was published, by a writer stopped in between, and one just after.
    store._change({"A": 100}, f"{store._generation()}/batch_id=never")
    store._change({"A": 1}, f"{store._generation()}/batch_id=compacted-0000")
    create("A", "new")
    assert counted() == {"A": 5}


def test_progress_counts_bad_rows_and_bytes(spark, store, catalog, folders):
    arrive(spark, folders, 0, 30, files=1)
    source = spark.readStream.schema(SCHEMA).parquet(folders["arrivals"])
    stream_pseudonymize(
        source, [ColumnMapping("value", "ns")], catalog, store, folders["output"], folders["progress"],
        folders["checkpoint"], "feed", bad=F.col("value") == "v3",
    ).awaitTermination()
    last = progress_snapshots(spark.read.parquet(folders["progress"])).collect()[-1]
    cells = [(str(i), "NA" if i % 5 == 0 else f"v{i % 17}") for i in range(30)]
    assert last.bytes_processed == sum(len(a) + len(b) for a, b in cells)
    assert last.bad_data_row_count == sum(b == "v3" for _, b in cells)
    assert spark.read.parquet(folders["output"]).columns == ["id", "value", "batch_id"]


def test_silent_jobs(spark, workspace):
    """Only running jobs without a late sign of life are told, once; one that goes on later is left alone."""
    now = datetime.now(UTC)
    old = now - timedelta(hours=1)
    ledger = JobLedger(spark, workspace.path("ledger"))
    rows = [
        (1, "run", old, "dead"), (1, "run", old, "done"), (2, "complete", old, "done"), (1, "queue", old, "waiting"),
        (1, "run", old, "lives"), (2, "progress", now + timedelta(hours=1), "lives"),
        (1, "run", old, "again"), (2, "stall", old, "again"), (3, "run", old, "again"),
    ]
    entries = [(seq, event, at, "me", *[None] * 6, job) for seq, event, at, job in rows]
    ledger.append_all(spark.createDataFrame(entries, LEDGER_SCHEMA))
    query = stream_stalled(ledger, workspace.path("checkpoint"), "watch", every="0 seconds")
    try:
        until = time.monotonic() + 60
        while query.isActive and time.monotonic() < until:
            if ledger.status("dead") == ledger.status("again") == 6:
                break
            time.sleep(0.5)
        done = query.lastProgress["batchId"]
        while query.isActive and time.monotonic() < until and query.lastProgress["batchId"] < done + 3:
            time.sleep(0.2)
    finally:
        query.stop()
    stalls = [r.id for r in ledger.read().where("event = 'stall' AND owner IS NULL").collect()]
    assert sorted(stalls) == ["again", "dead"]
    assert [ledger.status(j) for j in ("lives", "done", "waiting")] == [2, 3, 1]


def test_silent_jobs_share_a_bucket(spark, workspace):
    """Jobs of one bucket are one row of state; each is told by itself, also one that comes while the others go on."""
    now = datetime.now(UTC)
    old = now - timedelta(hours=1)
    schema, source, silent = "id string, seq long, event string, at timestamp", workspace.path("ledger"), workspace.path("silent")

    def arrive(*events):
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(source)

    def settle(query, batch):
        until = time.monotonic() + 60
        while query.isActive and time.monotonic() < until and (query.lastProgress or {"batchId": -1})["batchId"] < batch:
            time.sleep(0.2)

    arrive(
        ("dead", 1, "run", old), ("lives", 2, "progress", now + timedelta(hours=1)), ("lives", 1, "run", old),
        ("done", 2, "complete", old), ("done", 1, "run", old), (None, 1, "run", old), ("odd", None, "a,b", None),
    )
    query = (
        silent_jobs(spark.readStream.schema(schema).parquet(source), buckets=1)
        .writeStream.option("checkpointLocation", workspace.path("checkpoint"))
        .trigger(processingTime="0 seconds")
        .format("parquet")
        .start(silent)
    )
    try:
        settle(query, 2)
        arrive(("lives", 3, "progress", now + timedelta(hours=2)), ("late", 1, "run", old))
        settle(query, query.lastProgress["batchId"] + 4)
        assert query.exception() is None
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    finally:
        query.stop()
    told = spark.read.parquet(silent).collect()
    assert sorted(str(r.id) for r in told) == ["None", "dead", "late"]


def test_deletion_that_was_stopped(spark, store, catalog, workspace):
    """A deletion run again after it was stopped half-way takes off what there was before the first try."""
    rows = spark.createDataFrame([("A", "x"), ("B", "x")], "namespace_name string, original_value string")
    more = spark.createDataFrame([("B", "y"), ("B", "z")], "namespace_name string, original_value string")
    store.upsert(rows, catalog)
    store.upsert(more, catalog)
    place = f"deleted/{store._generation()}/batch_id=*/namespace_name=B"
    store._change({"B": -3}, place)
    files.delete(spark, files.glob(spark, f"{store._committed()[0]}/namespace_name=B")[0])
    store._announce()  # another change comes in between
    store.delete_namespace("B")
    snapshots = workspace.path("snapshots")
    stream_counts(store, snapshots, workspace.path("checkpoint"), "counts").awaitTermination()
    counted = spark.read.parquet(snapshots)
    newest = counted.agg(F.max("batch_id")).first()[0]
    found = {r.namespace_name: r.n for r in counted.where(F.col("batch_id") == newest).collect()}
    assert found == {"A": 1} and store.read().count() == 1


def test_stream_of_hash_namespaces_joins_no_mapping(spark, store, catalog, folders, monkeypatch):
    """Micro-batches whose rows name hash namespaces compute their pseudonyms: no mapping is broadcast or shuffled for them."""

    def joined(*_):
        raise AssertionError("a mapping was joined")

    monkeypatch.setattr("pseudospark.plans.transform.attach", joined)
    arrive(spark, folders, 0, 60)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folders["arrivals"])
    rows = source.withColumn("space", F.lit("hashed"))
    stream_pseudonymize(
        rows, [ColumnMapping("value", namespace_column="space")], catalog, store, folders["output"], folders["progress"],
        folders["checkpoint"], "feed",
    ).awaitTermination()
    found = spark.read.parquet(folders["output"])
    sha = F.upper(F.sha2(F.concat(F.lit("v"), F.col("id") % 17), 256))
    assert found.where(F.col("value") == F.when(F.col("id") % 5 == 0, "NA").otherwise(sha)).count() == found.count() == 60
    assert store.read().count() == 17
