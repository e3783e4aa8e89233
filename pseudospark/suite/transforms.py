"""Queries: replacing columns by pseudonyms and back."""

from pyspark.sql import functions as F

from pseudospark.functions.text import is_missing
from pseudospark.operators.resolve import attach, measure
from pseudospark.operators.store import distinct_requests
from pseudospark.plans.transform import (
    ColumnMapping,
    depseudonymize,
    job_counters,
    pseudonymize,
    split_blank,
)
from pseudospark.suite.common import catalog_of, mappings, namespaces, new_store, sha, table

SHA = ("Sha256HexEncoded", 64)


def pseudonymize_in_place(spark, sf):
    catalog = namespaces(spark, people=(*SHA, "p-"))
    df = table(spark, sf, "customer")
    return pseudonymize(df, [ColumnMapping("c_name", "people")], catalog, new_store(spark)).df


def pseudonymize_append(spark, sf):
    catalog = namespaces(spark, parts=SHA)
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return pseudonymize(df, [ColumnMapping("p_name", "parts", target="p_pseudonym")], catalog, new_store(spark)).df


def multi_mapping(spark, sf):
    """Three columns, two namespaces, both ways of output; a second in-place mapping of a column is ignored."""
    catalog = namespaces(spark, orders=(*SHA, "o-"), things=(*SHA, None, "-t"))
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    mapped = [
        ColumnMapping("l_orderkey", "orders"),
        ColumnMapping("l_orderkey", "things"),
        ColumnMapping("l_partkey", "things", target="part_pseudonym"),
        ColumnMapping("l_suppkey", "things", target="supp_pseudonym"),
        ColumnMapping("l_orderkey", "things", target="order_pseudonym"),
    ]
    return pseudonymize(df, mapped, catalog, new_store(spark)).df


def multi_namespace(spark, sf):
    """The namespace of each row comes from a column."""
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    catalog = catalog_of(events, "event_type", *SHA, prefix=F.concat(F.col("name"), F.lit("-")))
    mapping = ColumnMapping("user_id", namespace_column="event_type", target="pseudonym")
    return pseudonymize(events, [mapping], catalog, new_store(spark)).df


def _with_missing(spark, sf):
    kind = F.col("event_type")
    value = (
        F.when(kind == "error", F.lit(" na "))
        .when(kind == "signup", F.lit("Null\t"))
        .when(kind == "view", F.lit("  "))
        .otherwise(F.col("user_id").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", value.alias("value"))


WITH_MISSING_SQL = """
    SELECT event_id, CASE event_type WHEN 'error' THEN ' na ' WHEN 'signup' THEN 'Null' || chr(9) WHEN 'view' THEN '  '
        ELSE CAST(user_id AS VARCHAR) END AS value, event_type IN ('error', 'signup', 'view') AS missing FROM events
"""


def missing_values(spark, sf):
    df = _with_missing(spark, sf).withColumn("missing", is_missing(F.col("value")))
    catalog = namespaces(spark, users=SHA)
    return pseudonymize(df, [ColumnMapping("value", "users")], catalog, new_store(spark)).df


def blank_rejects(spark, sf):
    """Single creates reject blank values only: placeholders are values there."""
    usable, rejected = split_blank(_with_missing(spark, sf), "value")
    return usable.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))


def job_counters_query(spark, sf):
    """Counters of a job that maps the same column twice."""
    mapped = [ColumnMapping("value", "users"), ColumnMapping("value", "users", target="copy")]
    return job_counters(_with_missing(spark, sf), mapped)


def distinct_requests_query(spark, sf):
    requests = table(spark, sf, "events").select(
        F.col("event_type").alias("namespace_name"), F.col("user_id").cast("string").alias("original_value")
    )
    return distinct_requests(requests)


def forward_resolve(spark, sf):
    """Every line item with the stored pseudonym of its part."""
    store = new_store(spark)
    part = table(spark, sf, "part")
    epoch = F.lit("2024-01-01").cast("timestamp")
    stored = mappings(part, F.lit("parts"), F.col("p_partkey"), sha(F.col("p_name")), epoch)
    store.seed(stored, "parts")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    catalog = namespaces(spark, parts=SHA)
    return pseudonymize(items, [ColumnMapping("l_partkey", "parts")], catalog, store).df


def _attached(limit):
    """The join by itself, with a size limit that forces one of its ways."""

    def query(spark, sf):
        events = table(spark, sf, "events")
        store = new_store(spark)
        mapping = store.workspace.save(
            events.select(F.col("user_id").cast("string").alias("original_value"))
            .distinct()
            .withColumn("pseudonym_value", sha(F.col("original_value"))),
            "mapping",
        )
        known = F.col("event_type") != "error"
        df = events.select("event_id", "event_type", F.when(known, F.col("user_id").cast("string")).alias("key"))
        counts = store.workspace.save(
            df.where("key IS NOT NULL").groupBy(F.col("key").alias("original_value")).agg(F.count("*").alias("n")),
            "counts",
        )
        size = measure(mapping, "original_value", "pseudonym_value")
        keys = ["original_value"]
        return attach(
            df, ["key"], mapping, keys, "pseudonym_value", "pseudonym", counts, size, limit(size, counts)
        )[0]

    return query


ATTACHED_SQL = """
    SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS key,
           CASE WHEN event_type <> 'error' THEN upper(sha256(CAST(user_id AS VARCHAR))) END AS pseudonym
    FROM events
"""


def depseudonymize_query(spark, sf):
    """There and back with random pseudonyms."""
    store = new_store(spark)
    catalog = namespaces(spark, parts=("FullRandomHexEncoded", 24), supps=("FullRandomHexEncoded", 24))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    mapped = [ColumnMapping("l_partkey", "parts"), ColumnMapping("l_suppkey", "supps")]
    hidden = store.workspace.save(pseudonymize(items, mapped, catalog, store).df, "hidden")
    return depseudonymize(hidden, mapped, catalog, store).df


def depseudonymize_shuffled(spark, sf):
    """There and back where nothing fits a broadcast: two large mappings, a hot key, and many rows without a value."""
    store = new_store(spark, broadcast_bytes=0)
    catalog = namespaces(spark, kinds=("FullRandomHexEncoded", 24), users=("Uuid4", 36))
    events = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "view").otherwise(F.concat("event_type", F.col("event_id")))
    user = F.when(F.col("event_type") == "error", "NA").otherwise(F.col("user_id").cast("string"))
    df = events.select(kind.alias("kind"), user.alias("user"))
    mapped = [ColumnMapping("kind", "kinds"), ColumnMapping("user", "users")]
    hidden = store.workspace.save(pseudonymize(df, mapped, catalog, store).df, "hidden")
    return depseudonymize(hidden, mapped, catalog, store).df


def depseudonymize_unknown(spark, sf):
    """Purchases hold raw values, which no pseudonym matches; they stay."""
    events = table(spark, sf, "events")
    store = new_store(spark)
    user = F.col("user_id").cast("string")
    epoch = F.lit("2024-01-01").cast("timestamp")
    store.seed(mappings(events, F.lit("users"), user, sha(user), epoch), "users")
    shown = F.when(F.col("event_type") == "purchase", user).otherwise(sha(user))
    df = events.select("event_id", shown.alias("value"))
    return depseudonymize(df, [ColumnMapping("value", "users")], namespaces(spark, users=SHA), store).df


QUERIES = {
    "pseudonymize_in_place": pseudonymize_in_place,
    "pseudonymize_append": pseudonymize_append,
    "multi_mapping": multi_mapping,
    "multi_namespace": multi_namespace,
    "missing_values": missing_values,
    "blank_rejects": blank_rejects,
    "job_counters": job_counters_query,
    "distinct_requests": distinct_requests_query,
    "forward_resolve": forward_resolve,
    "forward_resolve_shuffled": _attached(lambda size, counts: 0),
    # Large enough for the hot keys' mapping, too small for the whole one.
    "forward_resolve_hot_keys": _attached(lambda size, counts: size - 1),
    "depseudonymize": depseudonymize_query,
    "depseudonymize_shuffled": depseudonymize_shuffled,
    "depseudonymize_unknown": depseudonymize_unknown,
}

ORACLE = {
    "pseudonymize_in_place": """
        SELECT c_custkey, 'p-' || upper(sha256(c_name)) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    """,
    "pseudonymize_append": """
        SELECT p_partkey, p_name, p_brand, upper(sha256(p_name)) AS p_pseudonym FROM part
    """,
    "multi_mapping": """
        SELECT 'o-' || upper(sha256(CAST(l_orderkey AS VARCHAR))) AS l_orderkey, l_linenumber, l_partkey, l_suppkey,
               l_quantity, l_returnflag,
               upper(sha256(CAST(l_partkey AS VARCHAR))) || '-t' AS part_pseudonym,
               upper(sha256(CAST(l_suppkey AS VARCHAR))) || '-t' AS supp_pseudonym,
               upper(sha256(CAST(l_orderkey AS VARCHAR))) || '-t' AS order_pseudonym
        FROM lineitem
    """,
    "multi_namespace": """
        SELECT event_id, event_type, user_id,
               event_type || '-' || upper(sha256(CAST(user_id AS VARCHAR))) AS pseudonym
        FROM events
    """,
    "missing_values": f"""
        SELECT event_id, CASE WHEN missing THEN value ELSE upper(sha256(value)) END AS value, missing
        FROM ({WITH_MISSING_SQL})
    """,
    "blank_rejects": f"""
        SELECT event_id, value, trim(value) = '' AS rejected FROM ({WITH_MISSING_SQL})
    """,
    "job_counters": f"""
        SELECT count(*) AS rows_processed, CAST(2 * sum(CAST(missing AS INT)) AS BIGINT) AS missing_value_count
        FROM ({WITH_MISSING_SQL})
    """,
    "distinct_requests": """
        SELECT event_type AS namespace_name, CAST(user_id AS VARCHAR) AS original_value, count(*) AS n
        FROM events GROUP BY ALL
    """,
    "forward_resolve": """
        SELECT l_orderkey, l_linenumber, upper(sha256(p_name)) AS l_partkey
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
    "forward_resolve_shuffled": ATTACHED_SQL,
    "forward_resolve_hot_keys": ATTACHED_SQL,
    "depseudonymize": """
        SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey
        FROM lineitem
    """,
    "depseudonymize_shuffled": """
        SELECT CASE event_type WHEN 'view' THEN 'view' ELSE event_type || CAST(event_id AS VARCHAR) END AS kind,
               CASE event_type WHEN 'error' THEN 'NA' ELSE CAST(user_id AS VARCHAR) END AS user
        FROM events
    """,
    "depseudonymize_unknown": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS value FROM events
    """,
}
