"""Queries: CSV files, FHIR documents and streams."""

import time

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pseudospark.operators.catalog import NamespaceCatalog
from pseudospark.operators.jobs import status_fold
from pseudospark.operators.ordered import numbered
from pseudospark.plans.csv_job import run_csv_job
from pseudospark.plans.fhir_batch import create_pseudonyms, judged_requests
from pseudospark.plans.guarded import Caller, Guard
from pseudospark.plans.job_run import JobLedger, run_recorded
from pseudospark.plans.transform import ColumnMapping, pseudonymize
from pseudospark.schemas import JOB_SCHEMA, PSEUDONYMIZE, RULE_SCHEMA, STATUS_CODES
from pseudospark.sources.csv import ROW, read_csv, write_csv
from pseudospark.sources.fhir import parse_parameters
from pseudospark.sources.files import Workspace
from pseudospark.streaming.microbatch import (
    progress_snapshots,
    stream_counts,
    stream_depseudonymize,
    stream_pseudonymize,
)
from pseudospark.streaming.supervision import silent_jobs
from pseudospark.suite.common import catalog_of, namespaces, new_store, ntz, order_mappings, table

SHA = ("Sha256HexEncoded", 64)

# -- CSV -------------------------------------------------------------------------------------------------------------------


def csv_scan(spark, sf):
    """Whole documents through a CSV file: line breaks, quotes and separators survive."""
    path = Workspace(spark).path("documents")
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    write_csv(documents, path, documents.columns, sep=";")
    read = read_csv(spark, path, sep=";")
    return read.df.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(read.header)])


def _event_lines(spark, sf, path):
    """Events as raw lines; errors hold a stray quote, sign-ups a quoted field with an escaped quote and a comma."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    cell = (
        F.when(kind == "error", F.concat(F.lit('se"'), user))
        .when(kind == "signup", F.concat(F.lit('"a ""q"", '), user, F.lit('"')))
        .otherwise(user)
    )
    line = F.concat_ws(",", F.col("event_id"), cell, kind)
    table(spark, sf, "events").select(line.alias("value")).write.text(path)


EVENT_CELL_SQL = """
    CASE event_type WHEN 'error' THEN 'se"' || CAST(user_id AS VARCHAR)
         WHEN 'signup' THEN 'a "q", ' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END
"""


def csv_tolerant(spark, sf):
    path = Workspace(spark).path("events")
    _event_lines(spark, sf, path)
    read = read_csv(spark, path, header=False)
    return read.df.select(
        F.col("_c0").alias("event_id"), F.col("_c1").alias("value"), F.col("_c2").alias("event_type")
    )


def csv_bad_rows(spark, sf):
    path = Workspace(spark).path("events")
    _event_lines(spark, sf, path)
    read = read_csv(spark, path, header=False)
    return read.df.agg(F.count(F.lit(1)).alias("n")).withColumn("bad_rows", F.lit(read.bad_rows).cast("long"))


def csv_many_files(spark, sf):
    """A file in parts, the first one small, with one header and a row equal to it: all rows, in their order."""
    workspace = Workspace(spark)
    path = workspace.path("parts")
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(key.cast("double").alias("at"), F.concat_ws(",", key, "c_name").alias("value"))
    header = spark.createDataFrame([(-1.0, "c_custkey,c_name"), (9.5, "c_custkey,c_name")], "at double, value string")
    lines = rows.unionByName(header)
    for folder, part in (("0", F.col("at") < 8), ("1", F.col("at") >= 8)):
        lines.where(part).orderBy("at").select("value").write.text(f"{path}/{folder}")
    read = read_csv(spark, f"{path}/*")
    placed = numbered(read.df.withColumn("file", F.lit(1)), ["file"], [F.col(ROW)], workspace)
    return placed.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(read.header)], "row_number")


def csv_blank_rows(spark, sf):
    """One column, in which cells of white space and empty cells are records."""
    path = Workspace(spark).path("names")
    segment = F.col("c_mktsegment")
    name = F.when(segment == "BUILDING", "   ").when(segment == "MACHINERY", "").otherwise(F.col("c_name"))
    write_csv(table(spark, sf, "customer").select(name.alias("name")), path, ["name"])
    return read_csv(spark, path).df.select(F.coalesce("_c0", F.lit("")).alias("name"))


def csv_long_delimiter(spark, sf):
    path = Workspace(spark).path("events")
    events = table(spark, sf, "events").select(F.concat_ws("||", "event_id", "user_id", "event_type").alias("value"))
    events.write.text(path)
    read = read_csv(spark, path, sep="||", header=False)
    cells = [F.col(f"_c{i}").alias(name) for i, name in enumerate(("event_id", "user_id", "event_type"))]
    return read.df.select(*cells, F.lit(read.width).alias("width"))


def csv_bad_width(spark, sf):
    """Lines with a stray quote and a quoted separator have as many fields as the others."""
    path = Workspace(spark).path("events")
    bad = F.col("event_type") == "error"
    note = F.when(bad, '"a,b"').otherwise(F.col("event_type"))
    user = F.when(bad, F.concat(F.lit('x"'), F.col("user_id"))).otherwise(F.col("user_id").cast("string"))
    table(spark, sf, "events").select(F.concat_ws(",", "event_id", user, note).alias("value")).write.text(path)
    read = read_csv(spark, path, header=False)
    cells = [F.col(f"_c{i}").alias(name) for i, name in enumerate(("event_id", "user", "note"))]
    return read.df.select(*cells, F.lit(read.width).alias("width"))


def _broken_lines(spark, sf, path):
    """Events as records of one, two or three lines; errors hold a stray quote before the quoted line break."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    broken = F.concat(F.lit('"a ""q"",\n'), user, F.when(kind == "signup", "\n,").otherwise(""), F.lit('"'))
    first = F.when(kind == "error", F.concat(F.lit('se"'), user)).otherwise(user)
    note = F.when(kind == "purchase", kind).otherwise(broken)
    table(spark, sf, "events").select(F.concat_ws(",", "event_id", first, note).alias("value")).write.text(path)


def csv_multi_line(spark, sf):
    path = Workspace(spark).path("events")
    _broken_lines(spark, sf, path)
    read = read_csv(spark, path, header=False)
    return read.df.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(("event_id", "user", "note"))])


def csv_multi_line_bad(spark, sf):
    path = Workspace(spark).path("events")
    _broken_lines(spark, sf, path)
    read = read_csv(spark, path, header=False)
    return read.df.agg(F.count(F.lit(1)).alias("n")).withColumn("bad_rows", F.lit(read.bad_rows).cast("long"))


def csv_sink(spark, sf):
    """A whole CSV job, its output read back as plain lines."""
    store = new_store(spark)
    workspace = store.workspace
    source, target = workspace.path("input"), workspace.path("output")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customer.write.option("header", True).csv(source)
    mapped = [ColumnMapping("c_name", "people"), ColumnMapping("c_custkey", "keys", target="key pseudonym")]
    catalog = namespaces(spark, people=(*SHA, "p,"), keys=SHA)
    run_csv_job(spark, source, target, mapped, PSEUDONYMIZE, catalog, store)
    return spark.read.text(target).withColumnRenamed("value", "line")


def job_run(spark, sf):
    """A job run twice, of which the second run does nothing, and one whose column does not exist: statuses, counters."""
    store = new_store(spark)
    workspace = store.workspace
    source, ledger = workspace.path("input"), JobLedger(spark, workspace.path("ledger"))
    segment = F.col("c_mktsegment")
    name = F.when(segment == "BUILDING", "NA").otherwise(F.col("c_name"))
    write_csv(table(spark, sf, "customer").select("c_custkey", name.alias("name")), source, ["c_custkey", "name"])
    catalog = namespaces(spark, people=SHA)
    for job, column in (("good", "name"), ("good", "name"), ("bad", "nowhere")):
        mapped = [ColumnMapping(column, "people")]
        try:
            run_recorded(spark, ledger, job, source, workspace.path("output"), mapped, PSEUDONYMIZE, catalog, store)
        except ValueError:
            pass  # recorded
    entries = ledger.read()
    facts = entries.groupBy("id").agg(
        F.count(F.when(F.col("event") != "progress", 1)).alias("n_events"),
        (F.count(F.when(F.col("event") == "progress", 1)) > 0).alias("told_progress"),
        F.max("rows_processed").alias("rows_processed"),
        F.max("missing_value_count").alias("missing_value_count"),
        F.max("bad_data_row_count").alias("bad_data_row_count"),
        F.max("error_message").alias("error_message"),
        F.coalesce(F.max("bytes_processed") > 0, F.lit(False)).alias("has_bytes"),
    )
    return facts.join(status_fold(entries, workspace), "id")


def job_owned(spark, sf):
    """A job that runs as its own row says: input and output keys, delimiter, header and columns."""
    store = new_store(spark)
    workspace = store.workspace
    root, ledger = workspace.path("objects"), JobLedger(spark, workspace.path("ledger"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    write_csv(customer, f"{root}/uploads/in.csv", None, sep="|")
    mapping = {"source_column": "1", "target_column": None, "namespace": "people"}
    row = {f.name: None for f in JOB_SCHEMA.fields} | {
        "id": "own", "status": STATUS_CODES["Queued"], "direction": PSEUDONYMIZE, "created_by": "someone",
        "input_object_key": "uploads/in.csv", "output_object_key": "results/own.csv", "encoding": "utf-8",
        "delimiter": "|", "has_header_row": False, "column_mappings": [mapping],
    }
    schema = StructType([StructField(f.name, f.dataType) for f in JOB_SCHEMA.fields])
    catalog = NamespaceCatalog(spark, workspace.path("catalog"))
    catalog.create(name="people", pseudonym_generation_method=SHA[0], pseudonym_length=SHA[1])
    guard = Guard(catalog, store, spark.createDataFrame([], RULE_SCHEMA), ["admin"])
    jobs_table = spark.createDataFrame([row], schema)
    guard.queue_job(Caller("root", ["admin"]), jobs_table, "own", ledger, root)
    guard.run_job(Caller("root", ["admin"]), jobs_table, "own", ledger, root)
    return spark.read.text(f"{root}/results/own.csv").select(
        F.col("value").alias("line"), F.lit(ledger.status("own")).alias("status")
    )


# -- FHIR ------------------------------------------------------------------------------------------------------------------


def _requests(spark, sf):
    """One request document per event; some kinds of event are broken in one way each."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")

    def parameter(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("valueString"))

    def document(*parameters):
        return F.to_json(
            F.struct(F.lit("Parameters").alias("resourceType"), F.array(*parameters).alias("parameter"))
        )

    text = (
        F.when(kind == "error", F.concat(F.lit('{"resourceType": "Parameters", "parameter": ['), user))
        .when(kind == "signup", document(parameter("namespace", kind), parameter("originalValue", F.lit(" \t"))))
        .otherwise(document(parameter("namespace", kind), parameter("originalValue", user)))
    )
    return table(spark, sf, "events").select("event_id", text.alias("document"))


def fhir_parse(spark, sf):
    parsed = parse_parameters(_requests(spark, sf), "document")
    return parsed.select("event_id", "well_formed", "namespace_name", "original_value")


def _write_rules(spark):
    return spark.createDataFrame([("view", [], ["writer"], []), ("click", [], ["writer"], [])], RULE_SCHEMA)


def fhir_errors(spark, sf):
    """The catalogue lacks 'click', and the rules close 'purchase'."""
    catalog = namespaces(spark, view=SHA, purchase=SHA)
    judged = judged_requests(_requests(spark, sf), "document", catalog, _write_rules(spark), ["writer"])
    return judged.select("event_id", "status_code", "diagnostics")


def fhir_create(spark, sf):
    catalog = namespaces(spark, view=SHA, purchase=SHA)
    answered = create_pseudonyms(
        _requests(spark, sf), "document", catalog, new_store(spark), _write_rules(spark), ["writer"]
    )
    return answered.select("event_id", "reply")


# -- streams ---------------------------------------------------------------------------------------------------------------


def _event_stream(spark, sf, workspace, df=None):
    """Events as a stream of four files, one per micro-batch."""
    events = df if df is not None else table(spark, sf, "events").select("event_id", "event_type", "user_id")
    path = workspace.path("arrivals")
    events.repartition(4).write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run_pseudonymize(spark, sf):
    store = new_store(spark)
    workspace = store.workspace
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    catalog = catalog_of(events, "event_type", *SHA)
    output, progress = workspace.path("output"), workspace.path("progress")
    query = stream_pseudonymize(
        _event_stream(spark, sf, workspace),
        [ColumnMapping("user_id", namespace_column="event_type")],
        catalog,
        store,
        output,
        progress,
        workspace.path("checkpoint"),
        "arrivals",
        bad=F.col("event_type") == "error",
    )
    query.awaitTermination()
    return store, output, progress


def stream_pseudonymize_query(spark, sf):
    _, output, _ = _run_pseudonymize(spark, sf)
    return spark.read.parquet(output).select("event_id", "event_type", "user_id")


def stream_progress(spark, sf):
    """The last progress snapshot has seen every row, missing cell, bad row and byte."""
    _, _, progress = _run_pseudonymize(spark, sf)
    snapshots = progress_snapshots(spark.read.parquet(progress))
    counters = ("rows_processed", "missing_value_count", "bad_data_row_count", "bytes_processed")
    return snapshots.agg(*[F.max(c).alias(c) for c in counters])


def stream_stalled_query(spark, sf):
    """Every ten events as the ledger of a job of long ago: a click starts it and an error ends it. A stream's timers tell of
    the jobs that were left running."""
    workspace = Workspace(spark)
    source, silent = workspace.path("ledger"), workspace.path("silent")
    kind = F.when(F.col("event_type") == "click", "run").when(F.col("event_type") == "error", "complete").otherwise("progress")
    events = table(spark, sf, "events").select(
        F.expr("event_id div 10").cast("string").alias("id"), F.col("event_id").cast("long").alias("seq"),
        kind.alias("event"), F.col("ts").cast("timestamp").alias("at"),
    )
    events.write.parquet(source)
    query = (
        silent_jobs(spark.readStream.schema(events.schema).parquet(source))
        .writeStream.option("checkpointLocation", workspace.path("checkpoint"))
        .trigger(processingTime="0 seconds")
        .format("parquet")
        .start(silent)
    )
    try:
        # The first micro-batch reads the ledger; timers run out in those after it, which need no data.
        while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < 2):
            time.sleep(0.2)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return spark.read.parquet(silent).select("id", ntz("last_sign"))


def stream_depseudonymize_query(spark, sf):
    """A stream of random pseudonyms, turned back."""
    store = new_store(spark)
    workspace = store.workspace
    catalog = namespaces(spark, users=("FullRandomBase62Encoded", 12))
    mapped = [ColumnMapping("user_id", "users")]
    events = table(spark, sf, "events").select("event_id", "user_id")
    hidden = workspace.save(pseudonymize(events, mapped, catalog, store).df, "hidden")
    output = workspace.path("output")
    query = stream_depseudonymize(
        _event_stream(spark, sf, workspace, hidden),
        mapped,
        catalog,
        store,
        output,
        workspace.path("progress"),
        workspace.path("checkpoint"),
        "returns",
    )
    query.awaitTermination()
    return spark.read.parquet(output).select("event_id", "user_id")


def stream_counts_query(spark, sf):
    """Counts per namespace as the store changes: three batches, one namespace deleted, a compaction, and a batch that
    nobody published."""
    store = new_store(spark)
    workspace = store.workspace
    for status in ("F", "O", "P"):
        rows = order_mappings(spark, sf, status).where(F.col("original_value").isNotNull())
        store.seed(rows, f"status-{status}")
    snapshots, checkpoint = workspace.path("snapshots"), workspace.path("checkpoint")
    stream_counts(store, snapshots, checkpoint, "counts").awaitTermination()
    store.delete_namespace("2-HIGH")
    store.compact()
    store.read().write.partitionBy("namespace_name").parquet(f"{store.path}/_staged/left-behind")
    stream_counts(store, snapshots, checkpoint, "counts").awaitTermination()
    counted = spark.read.parquet(snapshots)
    newest = counted.agg(F.max("batch_id")).scalar()
    return counted.where(F.col("batch_id") == newest).select("namespace_name", "n")


QUERIES = {
    "csv_scan": csv_scan,
    "csv_tolerant": csv_tolerant,
    "csv_bad_rows": csv_bad_rows,
    "csv_many_files": csv_many_files,
    "csv_blank_rows": csv_blank_rows,
    "csv_long_delimiter": csv_long_delimiter,
    "csv_bad_width": csv_bad_width,
    "csv_multi_line": csv_multi_line,
    "csv_multi_line_bad": csv_multi_line_bad,
    "csv_sink": csv_sink,
    "job_run": job_run,
    "job_owned": job_owned,
    "fhir_parse": fhir_parse,
    "fhir_errors": fhir_errors,
    "fhir_create": fhir_create,
    "stream_pseudonymize": stream_pseudonymize_query,
    "stream_progress": stream_progress,
    "stream_stalled": stream_stalled_query,
    "stream_depseudonymize": stream_depseudonymize_query,
    "stream_counts": stream_counts_query,
}

ERRORS_SQL = """
    SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id,
           CASE event_type WHEN 'error' THEN 400 WHEN 'signup' THEN 400 WHEN 'purchase' THEN 403 WHEN 'click' THEN 404
                ELSE 200 END AS status_code,
           CASE event_type WHEN 'error' THEN 'Received malformed or missing resource'
                WHEN 'signup' THEN 'namespace and/or originalValue are missing or blank in the Parameters request object'
                WHEN 'purchase' THEN 'Write access to namespace ''purchase'' is required.'
                WHEN 'click' THEN 'the namespace ''click'' could not be found.' END AS diagnostics
    FROM events
"""

PROGRESS_SQL = """
    SELECT count(*) AS rows_processed, CAST(0 AS BIGINT) AS missing_value_count,
           count(*) FILTER (event_type = 'error') AS bad_data_row_count,
           CAST(sum(strlen(CAST(event_id AS VARCHAR)) + strlen(event_type) + strlen(CAST(user_id AS VARCHAR))) AS BIGINT)
               AS bytes_processed
    FROM events
"""

ORACLE = {
    "csv_scan": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents",
    "csv_tolerant": f"SELECT CAST(event_id AS VARCHAR) AS event_id, {EVENT_CELL_SQL} AS value, event_type FROM events",
    "csv_multi_line": """
        SELECT CAST(event_id AS VARCHAR) AS event_id,
               CASE event_type WHEN 'error' THEN 'se"' ELSE '' END || CAST(user_id AS VARCHAR) AS user,
               CASE event_type WHEN 'purchase' THEN event_type
                    ELSE 'a "q",' || chr(10) || CAST(user_id AS VARCHAR)
                         || CASE event_type WHEN 'signup' THEN chr(10) || ',' ELSE '' END END AS note
        FROM events
    """,
    "csv_multi_line_bad": """
        SELECT count(*) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS bad_rows FROM events
    """,
    "csv_bad_rows": """
        SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad_rows FROM events
    """,
    "csv_many_files": """
        SELECT c_custkey, c_name, row_number() OVER (ORDER BY place) AS row_number
        FROM (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_custkey AS DOUBLE) AS place FROM customer
              UNION ALL SELECT 'c_custkey', 'c_name', 9.5)
    """,
    "csv_blank_rows": """
        SELECT CASE c_mktsegment WHEN 'BUILDING' THEN '   ' WHEN 'MACHINERY' THEN '' ELSE c_name END AS name
        FROM customer
    """,
    "csv_long_delimiter": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, 3 AS width
        FROM events
    """,
    "csv_bad_width": """
        SELECT CAST(event_id AS VARCHAR) AS event_id,
               CASE event_type WHEN 'error' THEN 'x"' ELSE '' END || CAST(user_id AS VARCHAR) AS user,
               CASE event_type WHEN 'error' THEN 'a,b' ELSE event_type END AS note, 3 AS width
        FROM events
    """,
    "csv_sink": """
        SELECT 'c_custkey,c_name,c_mktsegment,key pseudonym' AS line
        UNION ALL
        SELECT CAST(c_custkey AS VARCHAR) || ',"p,' || upper(sha256(c_name)) || '",' || c_mktsegment || ','
               || upper(sha256(CAST(c_custkey AS VARCHAR)))
        FROM customer
    """,
    "job_owned": """
        SELECT CAST(c_custkey AS VARCHAR) || '|' || upper(sha256(c_name)) || '|' || c_mktsegment AS line, 3 AS status
        FROM customer
    """,
    "job_run": """
        SELECT 'good' AS id, CAST(2 AS BIGINT) AS n_events, true AS told_progress, count(*) AS rows_processed,
               count(*) FILTER (c_mktsegment = 'BUILDING') AS missing_value_count,
               CAST(0 AS BIGINT) AS bad_data_row_count, CAST(NULL AS VARCHAR) AS error_message, true AS has_bytes,
               3 AS status
        FROM customer
        UNION ALL
        SELECT 'bad', 2, true, NULL, NULL, 0, 'The header has no column ''nowhere''.', false, 4
    """,
    "fhir_parse": """
        SELECT event_id, event_type <> 'error' AS well_formed,
               CASE WHEN event_type <> 'error' THEN event_type END AS namespace_name,
               CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN ' ' || chr(9) ELSE CAST(user_id AS VARCHAR) END
                   AS original_value
        FROM events
    """,
    "fhir_errors": f"SELECT event_id, status_code, diagnostics FROM ({ERRORS_SQL})",
    "fhir_create": f"""
        SELECT event_id, CASE
            WHEN diagnostics IS NULL THEN
                '{{"resourceType":"Parameters","parameter":[{{"name":"namespace","valueString":"' || event_type
                || '"}},{{"name":"originalValue","valueString":"' || user_id
                || '"}},{{"name":"pseudonymValue","valueString":"' || upper(sha256(user_id)) || '"}}]}}'
            ELSE '{{"resourceType":"OperationOutcome","issue":[{{"severity":"error","code":"'
                || CASE status_code WHEN 403 THEN 'forbidden' ELSE 'processing' END
                || '","diagnostics":"' || diagnostics || '"}}]}}' END AS reply
        FROM ({ERRORS_SQL})
    """,
    "stream_pseudonymize": """
        SELECT event_id, event_type, upper(sha256(CAST(user_id AS VARCHAR))) AS user_id FROM events
    """,
    "stream_progress": PROGRESS_SQL,
    "stream_stalled": """
        SELECT CAST(event_id // 10 AS VARCHAR) AS id, max(date_trunc('milliseconds', ts)) AS last_sign FROM events
        GROUP BY ALL
        HAVING bool_or(event_type = 'click') AND NOT bool_or(event_type = 'error')
    """,
    "stream_depseudonymize": "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM events",
    "stream_counts": """
        SELECT o_orderpriority AS namespace_name, count(*) AS n FROM orders
        WHERE o_orderpriority <> '2-HIGH' GROUP BY ALL
    """,
}
