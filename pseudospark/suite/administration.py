"""Queries: the catalogue, access rules and the job table."""

from datetime import datetime

from pyspark.sql import functions as F

from pseudospark.operators import access, jobs
from pseudospark.operators.catalog import NamespaceCatalog, unknown_namespaces, validated, with_namespace
from pseudospark.schemas import RULE_SCHEMA
from pseudospark.sources.files import Workspace
from pseudospark.suite.common import catalog_of, ntz, table

# -- catalogue -------------------------------------------------------------------------------------------------------------


def _part_definitions(spark, sf):
    """A namespace definition per part, many of them under the same name or with a wrong length."""
    part = table(spark, sf, "part")
    kind = F.col("p_type")
    method = (
        F.when(kind == "ECONOMY", "Uuid4")
        .when(kind == "STANDARD", "Uuid7")
        .when(kind == "PROMO", "Sha256HexEncoded")
        .when(kind == "LARGE", "FullRandomHexEncoded")
        .otherwise("Unspecified")
    )
    length = (
        F.when(kind.isin("ECONOMY", "STANDARD"), F.col("p_size"))
        .when(kind == "PROMO", F.col("p_size") + 14)
        .otherwise(F.col("p_size") - 1)
    )
    return part.select(
        F.col("p_name").alias("name"),
        F.concat(F.lit("from part "), F.col("p_partkey")).alias("description"),
        method.alias("pseudonym_generation_method"),
        length.cast("long").alias("pseudonym_length"),
        F.lit(None).cast("string").alias("pseudonym_prefix"),
        F.lit(None).cast("string").alias("pseudonym_suffix"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_updated_at"),
        F.col("p_partkey").alias("position"),
    )


DEFINITIONS_SQL = """
    SELECT *, CASE WHEN length <= 0 THEN 'The length is not positive.'
                   WHEN length <> required THEN method || ' always has length ' || CAST(required AS VARCHAR) || '.'
              END AS violation
    FROM (SELECT *, CASE method WHEN 'Uuid4' THEN 36 WHEN 'Uuid7' THEN 36 WHEN 'Sha256HexEncoded' THEN 64 END AS required
          FROM (SELECT p_partkey AS position, p_name AS name, 'from part ' || CAST(p_partkey AS VARCHAR) AS description,
                       CASE p_type WHEN 'ECONOMY' THEN 'Uuid4' WHEN 'STANDARD' THEN 'Uuid7'
                            WHEN 'PROMO' THEN 'Sha256HexEncoded' WHEN 'LARGE' THEN 'FullRandomHexEncoded'
                            ELSE 'Unspecified' END AS method,
                       CAST(CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_size
                            WHEN p_type = 'PROMO' THEN p_size + 14 ELSE p_size - 1 END AS BIGINT) AS length
                FROM part))
"""
CREATED_SQL = f"""
    SELECT name, min(position) AS position FROM ({DEFINITIONS_SQL}) WHERE violation IS NULL GROUP BY name
"""


def namespace_validate(spark, sf):
    checked = validated(_part_definitions(spark, sf))
    return checked.select("position", "name", "violation")


def _new_catalog(spark):
    return NamespaceCatalog(spark, Workspace(spark).path("catalog"))


def namespace_create(spark, sf):
    outcome = _new_catalog(spark).add(_part_definitions(spark, sf), ["position"])
    return outcome.select("position", "name", "outcome")


def namespace_init(spark, sf):
    """Configured names exist already when the parts' definitions arrive: they are not overwritten."""
    catalog = _new_catalog(spark)
    catalog.init(
        [
            {
                "name": name,
                "description": "configured",
                "pseudonym_generation_method": "SecureRandomBase64UrlEncoded",
                "pseudonym_length": 16,
                "pseudonym_prefix": "dev-",
            }
            for name in ("small ring", "red widget", "development")
        ]
    )
    catalog.add(_part_definitions(spark, sf), ["position"])
    return catalog.load().select("name", "description", "pseudonym_length")


def namespace_get(spark, sf):
    catalog = _new_catalog(spark)
    catalog.add(_part_definitions(spark, sf), ["position"])
    return catalog.get("small ring").select("name", "description", "pseudonym_generation_method")


def _customers_by_nation(spark, sf):
    nation = table(spark, sf, "nation")
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def unknown_namespaces_query(spark, sf):
    """Customers' nations, against a catalogue of the nations of large balances."""
    people = _customers_by_nation(spark, sf)
    rich = people.where(F.col("c_acctbal") > 9900)
    catalog = catalog_of(rich, "n_name", "Uuid4", 36)
    return unknown_namespaces(people, catalog, "n_name")


def with_namespace_query(spark, sf):
    people = _customers_by_nation(spark, sf).select("c_custkey", "n_name")
    catalog = catalog_of(people, "n_name", "Uuid4", 36, prefix=F.concat(F.col("name"), F.lit(":")))
    return with_namespace(people, catalog, "n_name").select("c_custkey", "n_name", "method", "length", "prefix")


# -- access ----------------------------------------------------------------------------------------------------------------


def _role(column, permission):
    return F.array(F.concat(column, F.lit(f"-{permission}")))


def _nation_rules(spark, sf):
    """One rule per nation, granting to roles of its region."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(
        F.col("n_name").alias("namespace"),
        _role(F.col("r_name"), "read").alias("read_roles"),
        _role(F.col("r_name"), "write").alias("write_roles"),
        _role(F.col("r_name"), "reverse").alias("reverse_lookup_roles"),
    )


def access_filter(spark, sf):
    """Customers in the nations that the caller may look up; a role for writing does not help."""
    people = _customers_by_nation(spark, sf).select("c_custkey", "n_name")
    roles = ["ASIA-reverse", "EUROPE-write", "AFRICA-reverse"]
    return access.accessible(people, "n_name", _nation_rules(spark, sf), roles, "reverse_lookup")


def access_wildcard(spark, sf):
    """A wildcard rule opens every namespace, known to the rules or not."""
    everywhere = spark.createDataFrame([("*", ["auditor"], [], [])], RULE_SCHEMA)
    rules = _nation_rules(spark, sf).unionByName(everywhere)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return access.accessible(orders, "o_orderpriority", rules, ["auditor"], "read")


def namespaces_readable(spark, sf):
    catalog = catalog_of(_customers_by_nation(spark, sf), "n_name", "Uuid4", 36)
    readable = access.accessible(catalog, "name", _nation_rules(spark, sf), ["AMERICA-read", "ASIA-write"], "read")
    return readable.select("name", "pseudonym_generation_method", "pseudonym_length")


def effective_roles(spark, sf):
    """Every customer adds a rule for its nation, every supplier one for all nations."""
    own = _customers_by_nation(spark, sf).select(
        F.col("n_name").alias("namespace"),
        F.array("c_mktsegment").alias("read_roles"),
        F.when(F.col("c_acctbal") > 5000, F.array("c_mktsegment", F.lit("writer"))).alias("write_roles"),
        F.array().cast("array<string>").alias("reverse_lookup_roles"),
    )
    everywhere = table(spark, sf, "supplier").select(
        F.lit("*").alias("namespace"),
        F.array(F.lit("auditor")).alias("read_roles"),
        F.array().cast("array<string>").alias("write_roles"),
        F.array(F.when(F.col("s_acctbal") > 0, "rich").otherwise("poor")).alias("reverse_lookup_roles"),
    )
    roles = access.effective_roles(table(spark, sf, "nation"), own.unionByName(everywhere), "n_name")
    return roles.select(
        "n_name", *[F.array_join(c, ",").alias(c) for c in ("read_roles", "write_roles", "reverse_lookup_roles")]
    )


def job_access(spark, sf):
    """Each customer asks for a job on the home nation and on NATION_0, with one role of the own making."""
    people = _customers_by_nation(spark, sf).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    mapping = "struct('c_name' AS source_column, CAST(NULL AS STRING) AS target_column, {0} AS namespace)"
    asked = people.select(
        F.col("c_custkey").alias("id"),
        (F.col("c_acctbal") < 2000).cast("int").alias("direction"),
        F.expr(f"array({mapping.format('n_name')}, {mapping.format(chr(39) + 'NATION_0' + chr(39))})").alias(
            "column_mappings"
        ),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("admin")))
        .when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("AFRICA-write"), F.lit("AFRICA-reverse")))
        .otherwise(_role(F.col("r_name"), "write"))
        .alias("roles"),
    )
    return access.denied_job_namespaces(asked, _nation_rules(spark, sf), ["admin"])


# -- jobs ------------------------------------------------------------------------------------------------------------------

STATUS_OF = {"view": 2, "click": 1, "purchase": 3, "error": 4, "signup": 6}
EVENT_OF = {"view": "run", "click": "queue", "purchase": "complete", "error": "stall", "signup": "cancel"}


def _coded(codes, column="event_type"):
    result = None
    for name, code in codes.items():
        chosen = F.col(column) == name
        result = F.when(chosen, F.lit(code)) if result is None else result.when(chosen, F.lit(code))
    return result


def _event_jobs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        _coded(STATUS_OF).alias("status"),
        F.col("user_id").cast("string").alias("created_by"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("last_updated_at"),
    )


EVENT_JOBS_SQL = """
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS created_by, ts AS created_at,
           ts AS last_updated_at,
           CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4
                WHEN 'signup' THEN 6 END AS status
    FROM events
"""


def jobs_list(spark, sf):
    mine = jobs.visible_jobs(_event_jobs(spark, sf), "8")
    return mine.select("id", "status", "created_by", ntz("created_at"))


def job_one_access(spark, sf):
    """Every order asks for the event job of its number on behalf of user 8; not all such jobs exist, and most are others'."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return jobs.access_outcome(asked, _event_jobs(spark, sf), "8")


def job_output_name(spark, sf):
    """Pages stand for uploads: the URL is the file name, unknown for pages of unlabelled documents."""
    pages = table(spark, sf, "pages").join(
        table(spark, sf, "labels"), F.col("page_id") == F.col("doc_id"), "left"
    )
    named = pages.select(
        F.col("page_id").cast("string").alias("id"),
        F.when(F.col("quality").isNotNull(), F.col("url")).alias("original_file_name"),
        F.coalesce("toxic", F.lit(0)).alias("direction"),
    )
    return named.withColumn("output_name", jobs.output_name())


def job_progress(spark, sf):
    running = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("bytes_processed"), F.col("o_custkey").alias("total_bytes")
    )
    return running.select("o_orderkey", jobs.progress_percent().alias("percent"))


def job_throughput(spark, sf):
    """Each user is a job, each event a snapshot; the row count goes up and down."""
    snapshots = table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("id"),
        F.col("ts").alias("last_updated_at"),
        F.round(F.col("value") * 100).cast("long").alias("rows_processed"),
        _coded(STATUS_OF).alias("status"),
    )
    rated = jobs.throughput(snapshots, Workspace(spark))
    return rated.select("event_id", "rows_per_second")


def jobs_stalled(spark, sf):
    swept = jobs.mark_stalled(_event_jobs(spark, sf), datetime(2024, 1, 15, 0, 10))
    return swept.select("id", "status", ntz("last_updated_at"), F.col("error_message").isNotNull().alias("told"))


def jobs_clear(spark, sf):
    left, cleared = jobs.clear_finished(_event_jobs(spark, sf), "8")
    return left.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("cleared", cleared.scalar())


def job_status_fold(spark, sf):
    ledger = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), _coded(EVENT_OF).alias("event")
    )
    return jobs.status_fold(ledger, Workspace(spark))


QUERIES = {
    "namespace_validate": namespace_validate,
    "namespace_create": namespace_create,
    "namespace_init": namespace_init,
    "namespace_get": namespace_get,
    "unknown_namespaces": unknown_namespaces_query,
    "with_namespace": with_namespace_query,
    "access_filter": access_filter,
    "access_wildcard": access_wildcard,
    "namespaces_readable": namespaces_readable,
    "effective_roles": effective_roles,
    "job_access": job_access,
    "jobs_list": jobs_list,
    "job_one_access": job_one_access,
    "job_output_name": job_output_name,
    "job_progress": job_progress,
    "job_throughput": job_throughput,
    "jobs_stalled": jobs_stalled,
    "jobs_clear": jobs_clear,
    "job_status_fold": job_status_fold,
}

ORACLE = {
    "namespace_validate": f"SELECT position, name, violation FROM ({DEFINITIONS_SQL})",
    "namespace_create": f"""
        SELECT d.position, d.name, coalesce(d.violation, CASE WHEN c.position = d.position THEN 'created' ELSE 'exists' END)
               AS outcome
        FROM ({DEFINITIONS_SQL}) d LEFT JOIN ({CREATED_SQL}) c ON c.name = d.name
    """,
    "namespace_init": f"""
        SELECT name, 'configured' AS description, CAST(16 AS BIGINT) AS pseudonym_length
        FROM (VALUES ('small ring'), ('red widget'), ('development')) v(name)
        UNION ALL
        SELECT d.name, d.description, d.length FROM ({DEFINITIONS_SQL}) d JOIN ({CREATED_SQL}) c USING (position)
        WHERE d.name NOT IN ('small ring', 'red widget', 'development')
    """,
    "namespace_get": f"""
        SELECT d.name, d.description, d.method AS pseudonym_generation_method
        FROM ({DEFINITIONS_SQL}) d JOIN ({CREATED_SQL}) c USING (position) WHERE d.name = 'small ring'
    """,
    "unknown_namespaces": """
        SELECT DISTINCT n_name AS namespace_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)
    """,
    "with_namespace": """
        SELECT c_custkey, n_name, 'Uuid4' AS method, CAST(36 AS BIGINT) AS length, n_name || ':' AS prefix
        FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
    "access_filter": """
        SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AFRICA')
    """,
    "access_wildcard": "SELECT o_orderkey, o_orderpriority FROM orders",
    "namespaces_readable": """
        SELECT DISTINCT n_name AS name, 'Uuid4' AS pseudonym_generation_method, CAST(36 AS BIGINT) AS pseudonym_length
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'AMERICA'
    """,
    "effective_roles": """
        WITH own AS (
            SELECT n_name, list(DISTINCT c_mktsegment) AS readers,
                   list(DISTINCT c_mktsegment) FILTER (c_acctbal > 5000) AS writers
            FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
        ), everywhere AS (
            SELECT list_sort(list(DISTINCT CASE WHEN s_acctbal > 0 THEN 'rich' ELSE 'poor' END)) AS lookers FROM supplier
        )
        SELECT n.n_name, array_to_string(list_sort(list_append(coalesce(readers, []), 'auditor')), ',') AS read_roles,
               array_to_string(CASE WHEN writers IS NULL THEN [] ELSE list_sort(list_append(writers, 'writer')) END, ',')
                   AS write_roles,
               (SELECT array_to_string(lookers, ',') FROM everywhere) AS reverse_lookup_roles
        FROM nation n LEFT JOIN own USING (n_name)
    """,
    "job_access": """
        WITH asked AS (
            SELECT c_custkey AS id, c_mktsegment, r_name AS home, unnest([n_name, 'NATION_0']) AS namespace,
                   CASE WHEN c_acctbal < 2000 THEN 'reverse_lookup' ELSE 'write' END AS permission
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        )
        SELECT DISTINCT id, namespace, permission
        FROM asked JOIN nation ON namespace = n_name JOIN region ON n_regionkey = r_regionkey
        WHERE c_mktsegment <> 'MACHINERY'
          AND NOT CASE WHEN c_mktsegment = 'BUILDING' THEN r_name = 'AFRICA'
                       ELSE permission = 'write' AND r_name = home END
    """,
    "jobs_list": f"SELECT id, status, created_by, created_at FROM ({EVENT_JOBS_SQL}) WHERE created_by = '8'",
    "job_one_access": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id,
               CASE WHEN event_id IS NULL THEN 'not found' WHEN user_id = 8 THEN 'found' ELSE 'forbidden' END AS outcome
        FROM orders LEFT JOIN events ON event_id = o_orderkey
    """,
    "job_output_name": """
        WITH named AS (
            SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN quality IS NOT NULL THEN url END AS original_file_name,
                   coalesce(toxic, 0) AS direction
            FROM pages LEFT JOIN labels ON page_id = doc_id
        )
        SELECT *, coalesce(regexp_replace(regexp_replace(original_file_name, '^.*/', '', 's'), '\\.[^.]*$', ''), id)
                  || '-' || CASE WHEN direction = 1 THEN 'de-' ELSE '' END || 'pseudonymized.csv' AS output_name
        FROM named
    """,
    "job_progress": """
        SELECT o_orderkey, CASE WHEN o_custkey > 0 THEN CAST(100.0 AS DOUBLE) * o_orderkey / o_custkey END AS percent
        FROM orders
    """,
    "job_throughput": f"""
        WITH snapshots AS (
            SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS n, event_type FROM events
        ), steps AS (
            SELECT *, n - lag(n) OVER w AS grown, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS elapsed
            FROM snapshots WINDOW w AS (PARTITION BY user_id ORDER BY ts, n)
        ), rates AS (
            SELECT *, CASE WHEN elapsed > 0 AND grown > 0 THEN grown / CAST(elapsed AS DOUBLE) END AS rate FROM steps
        ), filled AS (
            SELECT event_id, event_type, last_value(rate IGNORE NULLS) OVER (
                PARTITION BY user_id ORDER BY ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate
            FROM rates
        )
        SELECT event_id, CASE WHEN event_type = 'view' THEN rate END AS rows_per_second FROM filled
    """,
    "jobs_stalled": f"""
        WITH swept AS (
            SELECT *, status = 2 AND last_updated_at < TIMESTAMP '2024-01-15 00:00:00' AS stalled FROM ({EVENT_JOBS_SQL})
        )
        SELECT id, CASE WHEN stalled THEN 6 ELSE status END AS status,
               CASE WHEN stalled THEN TIMESTAMP '2024-01-15 00:10:00' ELSE last_updated_at END AS last_updated_at,
               stalled AS told
        FROM swept
    """,
    "jobs_clear": f"""
        WITH judged AS (SELECT *, status IN (3, 4, 5, 6) AND created_by = '8' AS cleared FROM ({EVENT_JOBS_SQL}))
        SELECT status, count(*) AS n, (SELECT count(*) FROM judged WHERE cleared) AS cleared
        FROM judged WHERE NOT cleared GROUP BY status
    """,
    "job_status_fold": """
        SELECT user_id AS id, CAST(list_reduce(list(event_type ORDER BY event_id), lambda s, e: CASE
                   WHEN e = 'click' THEN '1'
                   WHEN e = 'view' AND s IN ('0', '1', '2', '6') THEN '2'
                   WHEN e = 'purchase' AND s IN ('0', '1', '2', '3') THEN '3'
                   WHEN e = 'signup' AND s IN ('0', '1', '2') THEN '5'
                   WHEN e = 'error' AND s = '2' THEN '6'
                   ELSE s END, '0') AS INTEGER) AS status
        FROM events GROUP BY user_id
    """,
}
