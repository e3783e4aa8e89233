"""Structured Streaming: transform a stream batch by batch against a growing store."""

import operator
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from pseudospark.operators.store import MappingStore, observed
from pseudospark.plans.transform import ColumnMapping, Result, depseudonymize, pseudonymize
from pseudospark.schemas import MISSING_PLACEHOLDERS
from pseudospark.sources import files


def _start(
    stream: DataFrame,
    transform: Callable[[DataFrame, str], Result],
    output_path: str,
    progress_path: str,
    checkpoint: str,
    name: str,
    trigger: dict,
    bad: Column | None,
) -> StreamingQuery:
    """Every micro-batch overwrites its own output and progress folder, so a replayed batch changes nothing.

    Bytes are those of the arriving cells as text. They and the bad rows are seen by the pass that writes.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        sized, flagged = (f"__{kind}_{uuid.uuid4().hex}" for kind in ("bytes", "bad"))
        cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in batch.columns]
        is_bad = F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))
        measured = batch.select("*", reduce(operator.add, cells).alias(sized), is_bad.alias(flagged))
        result = transform(measured, f"{name}-{batch_id}")
        seen = Observation()
        metrics = F.sum(sized).alias("bytes"), F.count(F.when(F.col(flagged), 1)).alias("bad")
        try:
            written = result.df.observe(seen, *metrics).drop(sized, flagged)
            written.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")
        finally:
            result.release()
        stats = observed(seen)
        progress = batch.sparkSession.range(1).select(
            F.lit(name).alias("id"),
            F.current_timestamp().alias("last_updated_at"),
            F.lit(result.rows).cast("long").alias("rows_in_batch"),
            F.lit(result.missing).cast("long").alias("missing_in_batch"),
            F.lit(stats.get("bad", 0)).cast("long").alias("bad_in_batch"),
            F.lit(stats.get("bytes", 0)).cast("long").alias("bytes_in_batch"),
        )
        progress.write.mode("overwrite").parquet(f"{progress_path}/batch_id={batch_id}")

    return (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(handle)
        .start()
    )


def stream_pseudonymize(
    stream: DataFrame,
    mappings: Sequence[ColumnMapping],
    catalog: DataFrame,
    store: MappingStore,
    output_path: str,
    progress_path: str,
    checkpoint: str,
    name: str,
    placeholders=MISSING_PLACEHOLDERS,
    trigger: dict | None = None,
    bad: Column | None = None,
) -> StreamingQuery:
    """Pseudonymize a stream; one store batch per micro-batch. ``bad`` tells the rows that progress counts as bad.

    The store batch is named after the query and the micro-batch number, so a micro-batch that is run again finds the
    pseudonyms it stored before.
    """

    def transform(batch: DataFrame, batch_id: str) -> Result:
        return pseudonymize(batch, mappings, catalog, store, placeholders, batch_id)

    return _start(
        stream, transform, output_path, progress_path, checkpoint, name, trigger or {"availableNow": True}, bad
    )


def stream_depseudonymize(
    stream: DataFrame,
    mappings: Sequence[ColumnMapping],
    catalog: DataFrame,
    store: MappingStore,
    output_path: str,
    progress_path: str,
    checkpoint: str,
    name: str,
    placeholders=MISSING_PLACEHOLDERS,
    trigger: dict | None = None,
    bad: Column | None = None,
) -> StreamingQuery:
    """Turn the pseudonyms of a stream back; each micro-batch sees what the store holds by then."""

    def transform(batch: DataFrame, batch_id: str) -> Result:
        return depseudonymize(batch, mappings, catalog, store, placeholders)

    return _start(
        stream, transform, output_path, progress_path, checkpoint, name, trigger or {"availableNow": True}, bad
    )


def progress_snapshots(batches: DataFrame) -> DataFrame:
    """Running totals per micro-batch, from the progress folder (one row per micro-batch of a query)."""
    so_far = Window.partitionBy("id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batches.select(
        "id",
        "batch_id",
        "last_updated_at",
        F.sum("rows_in_batch").over(so_far).alias("rows_processed"),
        F.sum("missing_in_batch").over(so_far).alias("missing_value_count"),
        F.sum("bad_in_batch").over(so_far).alias("bad_data_row_count"),
        F.sum("bytes_in_batch").over(so_far).alias("bytes_processed"),
    )


def stream_counts(
    store: MappingStore, snapshot_path: str, checkpoint: str, name: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the number of mappings per namespace up to date while the store changes.

    Every micro-batch adds the changes that arrived to the snapshot before it and writes the sums under its own number, so
    a batch that is run again counts once, and the store is never listed.
    """

    def handle(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        before = f"{snapshot_path}/batch_id={batch_id - 1}"
        if batch_id and files.exists(spark, before):
            changes = changes.unionByName(spark.read.schema("namespace_name string, n long").parquet(before))
        counts = changes.groupBy("namespace_name").agg(F.sum("n").alias("n")).where("n <> 0")
        counts.write.mode("overwrite").parquet(f"{snapshot_path}/batch_id={batch_id}")

    return (
        store.changes()
        .writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(handle)
        .start()
    )
