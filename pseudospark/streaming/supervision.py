"""Supervision of running jobs as a stream: the ledger's events go in, jobs that fell silent come out."""

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pseudospark.operators.jobs import STALLED_AFTER, TRANSITIONS
from pseudospark.schemas import STATUS_CODES

RUNNING, STALLED = STATUS_CODES["Running"], STATUS_CODES["Stalled"]
#: Jobs whose state is one row and one call of Python, and the number of these; fixed while a checkpoint lives.
BUCKETS = 4096
STATE = "ids array<string>, statuses array<int>, signs array<long>"


def silent_jobs(events: DataFrame, threshold: timedelta = STALLED_AFTER, buckets: int = BUCKETS) -> DataFrame:
    """``id, last_sign, error_message`` of each job that runs and has shown no sign of life since ``threshold``.

    ``events`` is a stream of a ledger (``id, seq, event, at``). Each job's status and last sign of life are state, with a
    timer that every further event sets anew; a timer that runs out tells of the job once. The events of one micro-batch
    are taken in the order of ``seq``, those of later ones after them.

    Jobs are cut into ``buckets`` by a hash of their id. A bucket's state is read and written as one, and its timer is that of
    its job that is due first; choose their number so that a bucket holds some thousand jobs at most.
    """
    limit = int(threshold.total_seconds() * 1000)
    message = f"Stalled: no progress in over {threshold}."
    steps = list(TRANSITIONS.values())
    new = (STATUS_CODES["AwaitingUpload"], 0)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = {job: (status, last) for job, status, last in zip(*state.get)} if state.exists else {}
        arrived: dict[str | None, list[list[str]]] = {}
        if not state.hasTimedOut:
            for batch in batches:
                for job, entry in zip(batch["id"].tolist(), batch["entry"].tolist()):
                    arrived.setdefault(job, []).append(entry.split(","))
        now = state.getCurrentProcessingTimeMs()
        # Also while other jobs of the bucket go on; a job's own event comes before its timer.
        due = [j for j, (status, last) in jobs.items() if status == RUNNING and last + limit <= now and j not in arrived]
        if due:
            yield pd.DataFrame({"id": due, "last_sign": [jobs[j][1] for j in due]})
            jobs.update({j: (STALLED, jobs[j][1]) for j in due})
        for job, entries in arrived.items():
            status, last = jobs.get(job, new)
            for _, step, sign in sorted(entries, key=lambda entry: (not entry[0], int(entry[0] or 0))):
                status = steps[int(step)][status] if step else status
                last = max(last, int(sign)) if sign else last
            jobs[job] = (status, last)
        state.update((list(jobs), [status for status, _ in jobs.values()], [last for _, last in jobs.values()]))
        running = [last for status, last in jobs.values() if status == RUNNING]
        if running:
            state.setTimeoutDuration(max(1, min(running) + limit - now))

    # An event travels as one short text of its place, its step and its time.
    step = F.lit(None).cast("int")
    for i, event in enumerate(TRANSITIONS):
        step = F.when(F.col("event") == event, i).otherwise(step)
    parts = F.col("seq").cast("long"), step, F.unix_millis(F.col("at").cast("timestamp"))
    entry = F.concat_ws(",", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    silent = (
        events.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", entry.alias("entry"))
        .groupBy("bucket")
        .applyInPandasWithState(
            judge,
            "id string, last_sign long",
            STATE,
            "append",
            GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
    return silent.select("id", F.timestamp_millis("last_sign").alias("last_sign"), F.lit(message).alias("error_message"))


def stream_stalled(ledger, checkpoint: str, name: str, threshold: timedelta = STALLED_AFTER, every: str = "30 seconds") -> StreamingQuery:
    """Watch a ``JobLedger`` and append a ``stall`` event for every job that fell silent."""
    from pseudospark.plans.job_run import LEDGER_SCHEMA, stalled_events

    spark = ledger.spark
    if ledger.read().isEmpty():
        ledger.append_all(spark.createDataFrame([], LEDGER_SCHEMA))
    events = spark.readStream.schema(LEDGER_SCHEMA).parquet(ledger.path)

    def handle(silent: DataFrame, batch_id: int) -> None:
        ledger.append_all(stalled_events(silent))

    return (
        silent_jobs(events, threshold)
        .writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .foreachBatch(handle)
        .start()
    )
