import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import types as T

from pseudospark import ColumnMapping, MappingStore, NamespaceCatalog
from pseudospark.operators.jobs import with_events
from pseudospark.plans.guarded import Caller, ForbiddenError, Guard, NotFoundError
from pseudospark.plans.job_run import LEDGER_SCHEMA, JobLedger, run_recorded, sanitized
from pseudospark.schemas import DEPSEUDONYMIZE, JOB_SCHEMA, PSEUDONYMIZE, RULE_SCHEMA, STATUS_CODES
from pseudospark.sources import files

ADMIN, READER, WRITER, REVEALER, NOBODY = (
    Caller("root", ["admin"]), Caller("r", ["reader"]), Caller("w", ["writer"]), Caller("l", ["looker"]), Caller("n"),
)


@pytest.fixture
def guard(spark, workspace):
    roles = ["reader"], ["writer"], ["looker"]
    rules = spark.createDataFrame([("A", *roles), ("gone", *roles)], RULE_SCHEMA)
    built = Guard(
        NamespaceCatalog(spark, workspace.path("catalog")),
        MappingStore(spark, workspace.path("store"), workspace),
        rules,
        ["admin"],
    )
    for name in ("A", "B"):
        built.create_namespace(ADMIN, name=name, pseudonym_generation_method="Uuid4", pseudonym_length=36)
    return built


def asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), "namespace_name string, original_value string")


def test_namespaces(guard):
    assert [r.name for r in guard.namespaces(READER).collect()] == ["A"]
    assert guard.namespaces(ADMIN).count() == 2 and guard.namespaces(NOBODY).count() == 0
    assert guard.get_namespace(READER, "A").count() == 1
    with pytest.raises(ForbiddenError, match="Read access to namespace 'B'"):
        guard.get_namespace(READER, "B")
    with pytest.raises(NotFoundError, match="'gone'"):
        guard.get_namespace(NOBODY, "gone")
    with pytest.raises(ForbiddenError, match="Only an admin"):
        guard.create_namespace(WRITER, name="C", pseudonym_generation_method="Uuid4", pseudonym_length=36)
    with pytest.raises(ForbiddenError, match="Only an admin"):
        guard.delete_namespace(WRITER, "A")
    with pytest.raises(NotFoundError):
        guard.delete_namespace(ADMIN, "gone")


def test_create_list_reverse(spark, guard):
    with pytest.raises(ForbiddenError, match="Write access to namespace 'A'"):
        guard.create(READER, asked(spark, ("A", "x")))
    with pytest.raises(ForbiddenError, match="Write access to namespace 'B'"):
        guard.create(WRITER, asked(spark, ("A", "x"), ("B", "x")))
    with pytest.raises(ValueError, match="do not exist"):
        guard.create(WRITER, asked(spark, ("gone", "x")))
    with pytest.raises(ValueError, match="Blank"):
        guard.create(WRITER, asked(spark, ("A", " ")))
    done = guard.create(WRITER, asked(spark, ("A", "x"))).mappings.first()

    page = guard.page(READER, "A", with_total=True)
    assert page.total == 1 and page.items.first().pseudonym == done.pseudonym_value
    assert "original_value" not in page.items.columns
    with pytest.raises(ForbiddenError):
        guard.page(WRITER, "A")
    with pytest.raises(NotFoundError):
        guard.page(NOBODY, "gone")

    assert guard.reverse(REVEALER, "A", done.pseudonym_value).first().original_value == "x"
    assert guard.reverse(REVEALER, "gone", "p").count() == 0
    with pytest.raises(ForbiddenError, match="Reverse-lookup access"):
        guard.reverse(READER, "A", done.pseudonym_value)
    guard.delete_namespace(ADMIN, "A")
    assert guard.store.read().count() == 0


def test_jobs(spark, guard):
    def job(direction, *names):
        cell = "struct('c' AS source_column, CAST(NULL AS STRING) AS target_column, '{}' AS namespace)"
        mapped = ", ".join(cell.format(n) for n in names)
        return spark.sql(f"SELECT 'j' AS id, {direction} AS direction, array({mapped}) AS column_mappings")

    guard.check_job(WRITER, job(0, "A"))
    guard.check_job(REVEALER, job(1, "A"))
    guard.check_job(ADMIN, job(1, "A", "B"))
    with pytest.raises(ForbiddenError, match="Reverse-lookup access to namespace 'A'"):
        guard.check_job(WRITER, job(1, "A"))
    with pytest.raises(ForbiddenError, match="Write access to namespace 'B'"):
        guard.check_job(WRITER, job(0, "A", "B"))
    with pytest.raises(ForbiddenError):
        guard.check_job(NOBODY, job(0, "A"))


def test_tables(spark, guard):
    df = spark.createDataFrame([("x", "A"), ("y", "A")], "value string, ns string")
    own = [ColumnMapping("value", "A")]
    with pytest.raises(ForbiddenError, match="Write access to namespace 'A'"):
        guard.pseudonymize(READER, df, own)
    hidden = guard.store.workspace.save(guard.pseudonymize(WRITER, df, own).df, "hidden")
    with pytest.raises(ForbiddenError, match="Reverse-lookup access to namespace 'A'"):
        guard.depseudonymize(WRITER, hidden, own)
    assert {r.value for r in guard.depseudonymize(REVEALER, hidden, own).df.collect()} == {"x", "y"}
    by_column = [ColumnMapping("value", namespace_column="ns")]
    assert guard.pseudonymize(WRITER, df, by_column).rows == 2
    secret = spark.createDataFrame([("x", "A"), ("y", "B")], "value string, ns string")
    with pytest.raises(ForbiddenError, match="Access to 1 namespaces"):
        guard.pseudonymize(WRITER, secret, by_column)


def test_jobs_from_table_to_ledger(spark, guard, workspace, tmp_path):
    source = tmp_path / "in.csv"
    source.write_bytes("id;value\n1;x\n2;NA\né;y\n".encode("iso-8859-1"))
    mapping = {"source_column": "value", "target_column": None, "namespace": "A"}
    own = {"input_object_key": "in.csv", "delimiter": ";", "encoding": "ISO-8859-1", "has_header_row": True}
    jobs_of = (
        ("there", PSEUDONYMIZE, "w", "in.csv", "out/there.csv"),
        ("back", DEPSEUDONYMIZE, "w", "in.csv", None),
        ("other", PSEUDONYMIZE, "x", "in.csv", None),
        ("early", PSEUDONYMIZE, "w", "later.csv", None),
        ("outside", PSEUDONYMIZE, "w", "../in.csv", None),
        ("named", PSEUDONYMIZE, "w", "in.csv", None),
    )
    rows = [
        {f.name: None for f in JOB_SCHEMA.fields}
        | {"id": i, "status": 1, "direction": d, "created_by": by, "column_mappings": [mapping], **own}
        | {"input_object_key": key, "output_object_key": target}
        for i, d, by, key, target in jobs_of
    ]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in JOB_SCHEMA.fields])
    table = workspace.save(spark.createDataFrame(rows, schema), "jobs")
    ledger = JobLedger(spark, workspace.path("ledger"))

    def run(job):
        return guard.run_job(WRITER, table, job, ledger, str(tmp_path))

    with pytest.raises(NotFoundError, match="no such job"):
        run("nowhere")
    with pytest.raises(ForbiddenError, match="not the caller's"):
        run("other")
    with pytest.raises(ForbiddenError, match="Reverse-lookup access"):
        run("back")
    assert ledger.read().isEmpty()
    with pytest.raises(ValueError, match="not been uploaded"):
        guard.queue_job(WRITER, table, "early", ledger, str(tmp_path))
    with pytest.raises(ValueError, match="object key"):
        run("outside")
    assert ledger.read().isEmpty()
    size = source.stat().st_size
    assert guard.queue_job(WRITER, table, "there", ledger, str(tmp_path)) == size
    assert ledger.status("there") == STATUS_CODES["Queued"]
    done = run("there")
    assert (done.rows_processed, done.missing_value_count) == (3, 1)
    assert run("there") is None
    assert ledger.status("there") == STATUS_CODES["Completed"]
    events = [r.event for r in ledger.read().where("id = 'there'").orderBy("seq").collect()]
    assert events == ["queue", "run", "progress", "progress", "progress", "progress", "complete"]
    row = with_events(table, ledger.read(), workspace).where("id = 'there'").first()
    assert (row.status, row.total_bytes, row.bytes_processed, row.rows_processed) == (3, size, size, 3)
    assert (row.missing_value_count, row.bad_data_row_count) == (1, 0)
    parts = sorted((tmp_path / "out/there.csv").glob("part-*"))
    lines = "".join(p.read_text(encoding="iso-8859-1") for p in parts).splitlines()
    assert lines[0] == "id;value" and lines[2] == "2;NA" and len(lines) == 4 and not lines[1].endswith(";x")
    # Without an output key the result has the job's own name.
    assert run("named").rows_processed == 3 and (tmp_path / "named" / "named-pseudonymized.csv").is_dir()


def test_failed_and_stalled_runs(spark, guard, workspace, tmp_path):
    ledger = JobLedger(spark, workspace.path("ledger"))
    source = tmp_path / "in.csv"
    source.write_text("id,value\n1,secret\n")
    rest = [ColumnMapping("value", "A")], PSEUDONYMIZE, guard.catalog.load(), guard.store
    with pytest.raises(Exception, match="."):
        run_recorded(spark, ledger, "gone", str(tmp_path / "none.csv"), workspace.path("out"), *rest)
    assert ledger.status("gone") == STATUS_CODES["Failed"]
    assert "none.csv" not in ledger.read().where("event = 'fail'").first().error_message
    assert run_recorded(spark, ledger, "gone", str(source), workspace.path("out"), *rest) is None
    ledger.append("slow", "run")
    ledger.append("slow", "stall")
    assert run_recorded(spark, ledger, "slow", str(source), workspace.path("out"), *rest).rows_processed == 1
    assert ledger.status("slow") == STATUS_CODES["Completed"]
    assert sanitized(RuntimeError("cell content")) == "RuntimeError"


def test_a_job_has_one_runner(spark, workspace):
    ledger = JobLedger(spark, workspace.path("ledger"))
    first = ledger.claim("job")
    assert first is not None and ledger.claim("job") is None
    # Two that claim at the same time: the first in the ledger has it.
    ledger.append("race", "run", "a")
    ledger.append("race", "run", "b")
    assert ledger._folded("race") == (STATUS_CODES["Running"], "a")
    ledger.append("race", "stall")
    again = ledger.claim("race")
    assert ledger._folded("race") == (STATUS_CODES["Running"], again)


def test_cancel_reaches_a_running_job(spark, guard, workspace, tmp_path):
    ledger, out = JobLedger(spark, workspace.path("ledger")), workspace.path("out")
    source = tmp_path / "in.csv"
    source.write_text("id,value\n1,x\n")
    told = []

    class Slow(type(guard.store)):
        """Cancelled from elsewhere while pseudonyms are made."""

        def save_requests(self, *args):
            ledger.append("job", "cancel")
            told.append("cancelled")
            return super().save_requests(*args)

    store = Slow(spark, workspace.path("store"), workspace)
    rest = [ColumnMapping("value", "A")], PSEUDONYMIZE, guard.catalog.load(), store
    assert run_recorded(spark, ledger, "job", str(source), out, *rest) is None
    assert told and ledger.status("job") == STATUS_CODES["Cancelled"] and not files.exists(spark, out)
    assert ledger.read().where("event IN ('complete', 'fail')").isEmpty()


def test_signs_of_life_keep_a_job_from_the_sweep(spark, guard, workspace, tmp_path):
    ledger, out = JobLedger(spark, workspace.path("ledger")), workspace.path("out")
    source = tmp_path / "in.csv"
    source.write_text("id,value\n1,x\n")
    seen = []

    class Slow(type(guard.store)):
        def save_requests(self, *args):
            time.sleep(4)
            seen.append(ledger.read().where("event = 'progress'").count())
            return super().save_requests(*args)

    store = Slow(spark, workspace.path("store"), workspace)
    rest = [ColumnMapping("value", "A")], PSEUDONYMIZE, guard.catalog.load(), store
    assert run_recorded(spark, ledger, "alive", str(source), out, *rest, heartbeat=timedelta(seconds=0.5)) is not None
    assert seen[0] >= 3  # one after the input was read, the others meanwhile

    now = datetime.now(UTC)
    row = {f.name: None for f in JOB_SCHEMA.fields} | {"status": 2, "created_by": "w", "last_updated_at": now - timedelta(hours=1)}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in JOB_SCHEMA.fields])
    table = spark.createDataFrame([{**row, "id": i} for i in ("dead", "lives", "alive")], schema)
    long_ago = (1, "run", now - timedelta(hours=1), "other", *[None] * 6, "dead")
    ledger.append_all(spark.createDataFrame([long_ago], LEDGER_SCHEMA))
    ledger.append("lives", "run", "me")
    ledger.append("lives", "progress", "me", rows_processed=5)
    swept = {r.id: (r.status, r.rows_processed) for r in ledger.sweep(table, now + timedelta(minutes=9)).collect()}
    assert swept == {"dead": (6, None), "lives": (2, 5), "alive": (3, 1)}
    assert ledger.status("dead") == STATUS_CODES["Stalled"]
    assert {r.status for r in ledger.sweep(table, now + timedelta(minutes=12)).collect()} == {6, 3}
