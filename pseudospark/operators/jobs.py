"""The table of jobs and the ledger of job events, as DataFrame -> DataFrame functions."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pseudospark.operators.ordered import POSITION, SLICE, along_group, in_slice, sliced, with_summary
from pseudospark.schemas import DEPSEUDONYMIZE, OUTPUT_ENDINGS, PSEUDONYMIZE, STATUS_CODES
from pseudospark.sources.files import Workspace

STALLED_AFTER = timedelta(minutes=10)
CHUNK = 10_000  # ledger entries that are folded as one list
FINISHED = [STATUS_CODES[s] for s in ("Completed", "Failed", "Cancelled", "Stalled")]

# What each event makes of each status code 0 to 6.
TRANSITIONS = {
    "queue": [1, 1, 1, 1, 1, 1, 1],
    # A run skips ended jobs but redoes a stalled one.
    "run": [2, 2, 2, 3, 4, 5, 2],
    # A late success never hides that a job was failed, cancelled or given up on.
    "complete": [3, 3, 3, 3, 4, 5, 6],
    "fail": [4, 4, 4, 4, 4, 4, 4],
    "cancel": [5, 5, 5, 3, 4, 5, 6],
    "stall": [0, 1, 6, 3, 4, 5, 6],
}


def visible_jobs(jobs: DataFrame, subject: str, admin: bool = False) -> DataFrame:
    """The caller's jobs, or all for an admin, newest first."""
    own = jobs if admin else jobs.where(F.col("created_by") == subject)
    return own.orderBy(F.col("created_at").desc())


def may_access(subject: str, admin: bool = False) -> Column:
    return F.lit(admin) | (F.col("created_by") == subject)


def access_outcome(asked: DataFrame, jobs: DataFrame, subject: str, admin: bool = False) -> DataFrame:
    """What becomes of each asked ``id``: ``found``, ``forbidden`` if the job is another's, ``not found`` if there is none.

    Existence is judged before ownership. A repeated request is answered each time; a null id is not found.
    """
    own = may_access(subject, admin)
    known = jobs.select(F.col("id").alias("__id"), F.coalesce(own, F.lit(False)).alias("__own"))
    outcome = F.when(F.col("__id").isNull(), "not found").when(F.col("__own"), "found").otherwise("forbidden")
    joined = asked.join(known, F.col("id") == F.col("__id"), "left")
    return joined.withColumn("outcome", outcome).drop("__id", "__own")


def output_name() -> Column:
    """Download name of a job's result: the uploaded file's base name, else the job's id."""
    file_name = F.regexp_replace("original_file_name", "(?s)^.*/", "")
    base = F.coalesce(F.regexp_replace(file_name, r"\.[^.]*$", ""), F.col("id"))
    back = F.col("direction") == DEPSEUDONYMIZE
    return F.concat(base, F.when(back, OUTPUT_ENDINGS[DEPSEUDONYMIZE]).otherwise(OUTPUT_ENDINGS[PSEUDONYMIZE]))


def progress_percent() -> Column:
    done = F.lit(100.0) * F.col("bytes_processed") / F.col("total_bytes")
    return F.when(F.col("total_bytes") > 0, done)


def is_stalled(as_of: datetime, threshold: timedelta = STALLED_AFTER) -> Column:
    running = F.col("status") == STATUS_CODES["Running"]
    return running & (F.col("last_updated_at") < F.lit(as_of - threshold))


def mark_stalled(jobs: DataFrame, as_of: datetime, threshold: timedelta = STALLED_AFTER) -> DataFrame:
    """The table after a sweep: running jobs without recent progress are given up on."""
    stalled = is_stalled(as_of, threshold)
    message = f"Stalled: no progress in over {threshold}."
    changes = {
        "status": F.lit(STATUS_CODES["Stalled"]),
        "error_message": F.lit(message),
        "last_updated_at": F.lit(as_of),
    }
    return jobs.select(
        *[F.when(stalled, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else c for c in jobs.columns]
    )


def is_cleared(subject: str, admin: bool = False) -> Column:
    return F.col("status").isin(FINISHED) & may_access(subject, admin)


def clear_finished(jobs: DataFrame, subject: str, admin: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table without the caller's finished jobs, and how many those were."""
    cleared = is_cleared(subject, admin)
    return jobs.where(~cleared), jobs.where(cleared).agg(F.count(F.lit(1)).alias("cleared"))


def throughput(snapshots: DataFrame, workspace: Workspace) -> DataFrame:
    """Rows per second of each progress snapshot (``id``, ``last_updated_at``, ``rows_processed``, ``status``).

    The rate is taken against the job's previous snapshot where time moved and rows grew; otherwise the last known rate
    stands. Shown while a job runs only. A job's snapshots may span many tasks.
    """
    group = ["id"]
    rows = sliced(snapshots, group, [F.col("last_updated_at"), F.col("rows_processed")], workspace)
    snapshot = F.struct(F.col("last_updated_at").alias("at"), F.col("rows_processed").alias("rows"))
    edges = (
        rows.groupBy("id", SLICE)
        .agg(F.max_by(snapshot, POSITION).alias("__last"))
        .withColumn("__carried", F.lag("__last").over(along_group(group)))
        .drop("__last")
    )
    previous = F.coalesce(F.lag(snapshot).over(in_slice(group)), F.col("__carried"))
    elapsed = (F.unix_micros(_utc("last_updated_at")) - F.unix_micros(_utc("__previous.at"))) / F.lit(1e6)
    grown = F.col("rows_processed") - F.col("__previous.rows")
    rated = workspace.save(
        with_summary(rows, edges, group)
        .withColumn("__previous", previous)
        .withColumn("__rate", F.when((elapsed > 0) & (grown > 0), grown / elapsed))
        .drop("__carried", "__previous"),
        "rated",
    )
    earlier = along_group(group).rowsBetween(Window.unboundedPreceding, -1)
    known = (
        rated.where(F.col("__rate").isNotNull())
        .groupBy("id", SLICE)
        .agg(F.max_by("__rate", POSITION).alias("__last"))
    )
    slices = rated.groupBy("id", SLICE).agg(F.count(F.lit(1)).alias("__n"))
    carried = (
        slices.join(known, ["id", SLICE], "left")
        .withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier))
        .select("id", SLICE, "__carried")
    )
    so_far = in_slice(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.coalesce(F.last("__rate", ignorenulls=True).over(so_far), F.col("__carried"))
    running = F.col("status") == STATUS_CODES["Running"]
    return (
        with_summary(rated, carried, group)
        .withColumn("rows_per_second", rate)
        .withColumn("rows_per_second", F.when(running, F.col("rows_per_second")))
        .select(*snapshots.columns, "rows_per_second")
    )


def _utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


def _composed(step: str, order: str) -> Column:
    """The effect of a group's events in order, as one table status -> status."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(step).alias("t"))))
    identity = F.array(*[F.lit(i) for i in range(len(STATUS_CODES))])
    return F.aggregate(
        ordered,
        identity,
        lambda so_far, event: F.transform(so_far, lambda status: F.element_at(event["t"], status + 1)),
    )


def status_fold(events: DataFrame, workspace: Workspace) -> DataFrame:
    """Each job's status after its ledger of events (``id``, ``seq``, ``event``).

    An event is a table from old to new status, and such tables compose. So each slice of a long ledger folds by itself,
    and only the composed tables are folded per job.
    """
    table = F.array(*[F.lit(i) for i in range(len(STATUS_CODES))])
    for event, targets in TRANSITIONS.items():
        table = F.when(F.col("event") == event, F.array(*[F.lit(t) for t in targets])).otherwise(table)
    rows = sliced(events, ["id"], [F.col("seq")], workspace)
    # Three levels, so that no list grows with the ledger: chunks of a slice, slices of a job, the job.
    chunk = F.floor(F.col(POSITION) / CHUNK).alias("chunk")
    per_chunk = (
        rows.withColumn("step", table).groupBy("id", SLICE, chunk).agg(_composed("step", POSITION).alias("step"))
    )
    per_slice = per_chunk.groupBy("id", SLICE).agg(_composed("step", "chunk").alias("step"))
    per_job = per_slice.groupBy("id").agg(_composed("step", SLICE).alias("step"))
    start = STATUS_CODES["AwaitingUpload"]
    return per_job.select("id", F.element_at("step", start + 1).alias("status"))


def with_events(jobs: DataFrame, events: DataFrame, workspace: Workspace) -> DataFrame:
    """The table of jobs as its ledger has it: status, counters and time of the last event.

    A counter has its newest value; a job without events stays as it is.
    """
    counters = ["total_bytes", "bytes_processed", "rows_processed", "missing_value_count", "bad_data_row_count", "error_message"]
    newest = events.groupBy("id").agg(
        F.max("at").alias("__at"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in counters],
    )
    folded = status_fold(events, workspace).select("id", F.col("status").alias("__status"))
    known = newest.join(folded, "id")
    changed = {"status": "__status", "last_updated_at": "__at", **{c: f"__{c}" for c in counters}}
    return jobs.join(known, "id", "left").select(
        *[F.coalesce(changed[c], c).alias(c) if c in changed else F.col(c) for c in jobs.columns]
    )
