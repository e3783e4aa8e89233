import random
from datetime import datetime, timedelta

import pytest

from pseudospark.operators import jobs
from pseudospark.schemas import JOB_SCHEMA

NOW = datetime(2024, 5, 1, 12, 0)


@pytest.fixture
def make(spark):
    def build(*overrides):
        rows = []
        for i, changes in enumerate(overrides):
            row = {
                "id": f"job-{i}", "status": 2, "direction": 0, "created_by": "alice", "input_object_key": "in",
                "output_object_key": None, "original_file_name": None, "encoding": "utf-8", "delimiter": ",",
                "has_header_row": True, "column_mappings": [], "total_bytes": 0, "bytes_processed": 0,
                "rows_processed": 0, "bad_data_row_count": 0, "missing_value_count": 0, "error_message": None,
                "created_at": NOW + timedelta(minutes=i), "last_updated_at": NOW,
            }
            rows.append(tuple({**row, **changes}[name] for name in JOB_SCHEMA.names))
        return spark.createDataFrame(rows, JOB_SCHEMA)

    return build


def test_only_running_and_old_jobs_are_stalled(make):
    old, fresh = NOW - timedelta(minutes=20), NOW - timedelta(minutes=1)
    df = make(
        {"status": 2, "last_updated_at": old},
        {"status": 2, "last_updated_at": fresh},
        {"status": 3, "last_updated_at": old},
        {"status": 1, "last_updated_at": old},
        {"status": 2, "last_updated_at": NOW - timedelta(minutes=10)},
    )
    swept = jobs.mark_stalled(df, NOW).orderBy("id").collect()
    assert [r.status for r in swept] == [6, 2, 3, 1, 2]
    assert swept[0].last_updated_at == NOW and "0:10:00" in swept[0].error_message
    assert swept[1].error_message is None and swept[1].last_updated_at == fresh
    assert swept[0].asDict().keys() == set(JOB_SCHEMA.names)


def test_jobs_of_the_owner_or_all_for_an_admin(make):
    df = make({"created_by": "alice"}, {"created_by": "bob"}, {"created_by": "alice"})
    assert [r.id for r in jobs.visible_jobs(df, "alice").collect()] == ["job-2", "job-0"]
    assert [r.id for r in jobs.visible_jobs(df, "root", admin=True).collect()] == ["job-2", "job-1", "job-0"]
    assert df.where(jobs.may_access("bob")).count() == 1
    assert df.where(jobs.may_access("eve")).count() == 0


def test_clear_finished(make):
    df = make(*[{"status": s, "created_by": who} for s in range(7) for who in ("alice", "bob")])
    left, cleared = jobs.clear_finished(df, "alice")
    assert cleared.first().cleared == 4 and left.count() == 10
    left, cleared = jobs.clear_finished(df, "root", admin=True)
    assert cleared.first().cleared == 8
    assert {r.status for r in left.collect()} == {0, 1, 2}


def test_output_names(make):
    df = make(
        {"original_file_name": "patients_2026.csv"},
        {"original_file_name": "a.b.tsv", "direction": 1},
        {},
        {"original_file_name": "noext"},
        {"original_file_name": "dir.d/x.csv"},
        {"original_file_name": ".csv"},
    )
    got = [r[0] for r in df.orderBy("id").select(jobs.output_name()).collect()]
    assert got == [
        "patients_2026-pseudonymized.csv", "a.b-de-pseudonymized.csv", "job-2-pseudonymized.csv",
        "noext-pseudonymized.csv", "x-pseudonymized.csv", "-pseudonymized.csv",
    ]


def test_progress(make):
    df = make({"total_bytes": 200, "bytes_processed": 50}, {"total_bytes": 0, "bytes_processed": 5})
    assert [r[0] for r in df.orderBy("id").select(jobs.progress_percent()).collect()] == [25.0, None]


@pytest.fixture
def many_slices(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_throughput_against_brute_force(spark, workspace, many_slices):
    """One job holds most snapshots, over many slices; long runs without growth carry a rate far along."""
    rng = random.Random(3)
    data, rows = [], {}
    for i in range(2500):
        job = rng.choice(["big"] * 8 + ["a", "b"])
        step = 0 if 800 < i < 1900 else rng.choice([0, 0, 5, 100, -20])
        rows[job] = rows.get(job, 0) + step
        data.append((job, NOW + timedelta(seconds=i + rng.random() / 2), rows[job], rng.choice([2, 2, 3])))
    df = spark.createDataFrame(data, "id string, last_updated_at timestamp, rows_processed long, status int")
    got = jobs.throughput(df.repartition(4), workspace).collect()
    expected, last, rate = {}, {}, {}
    for job, at, n, status in sorted(data, key=lambda r: r[1]):
        if job in last and at > last[job][0] and n > last[job][1]:
            rate[job] = (n - last[job][1]) / (at - last[job][0]).total_seconds()
        last[job] = (at, n)
        expected[job, at] = rate.get(job) if status == 2 else None
    assert len(got) == len(data)
    for row in got:
        want = expected[row.id, row.last_updated_at]
        assert row.rows_per_second == (want if want is None else pytest.approx(want))


def test_status_fold_against_brute_force(spark, workspace, many_slices, monkeypatch):
    monkeypatch.setattr(jobs, "CHUNK", 7)
    rng = random.Random(9)
    names = [*jobs.TRANSITIONS, "progress"]
    data = [(rng.choice([0] * 20 + list(range(1, 30))), i, rng.choice(names)) for i in range(2500)]
    df = spark.createDataFrame(data, "id int, seq int, event string")
    expected = {}
    ended = {3, 4, 5}
    for job, _, event in data:
        status = expected.get(job, 0)
        if event == "queue":
            status = 1
        elif event == "fail":
            status = 4
        elif event == "run" and status not in ended:
            status = 2
        elif event == "complete" and status not in (4, 5, 6):
            status = 3
        elif event == "cancel" and status not in (3, 4, 5, 6):
            status = 5
        elif event == "stall" and status == 2:
            status = 6
        expected[job] = status
    got = jobs.status_fold(df.repartition(3), workspace).collect()
    assert {r.id: r.status for r in got} == expected and len(got) == len(expected)


def test_rules_of_a_rerun(spark, workspace):
    """A stalled job may run again, an ended one may not; a late success hides nothing."""
    ledgers = {
        "redone": ["queue", "run", "stall", "run", "complete"],
        "late": ["queue", "run", "stall", "complete"],
        "cancelled": ["queue", "run", "cancel", "complete", "run"],
        "done": ["queue", "run", "complete", "cancel", "run", "stall"],
        "waiting": ["progress"],
    }
    data = [(job, i, event) for job, events in ledgers.items() for i, event in enumerate(events)]
    df = spark.createDataFrame(data, "id string, seq int, event string")
    got = {r.id: r.status for r in jobs.status_fold(df, workspace).collect()}
    assert got == {"redone": 3, "late": 6, "cancelled": 5, "done": 3, "waiting": 0}


def test_access_to_single_jobs(spark):
    """A job that does not exist is told apart from another's; repeated and null requests are answered as well."""
    table = spark.createDataFrame([("a", "me"), ("b", "you"), ("c", None)], "id string, created_by string")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "id string")

    def outcomes(**options):
        return sorted((r.id or "", r.outcome) for r in jobs.access_outcome(asked, table, "me", **options).collect())

    assert outcomes() == [("", "not found"), ("a", "found"), ("a", "found"), ("b", "forbidden"), ("c", "forbidden"), ("d", "not found")]
    assert [o for _, o in outcomes(admin=True)].count("found") == 4
