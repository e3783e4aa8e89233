"""Queries: the mapping store, its upsert, pages, counts and checks."""

from pyspark.sql import functions as F

from pseudospark.operators import checks, lookup
from pseudospark.operators.catalog import without_namespace
from pseudospark.operators.store import pick_misses
from pseudospark.plans.transform import ColumnMapping, pseudonymize
from pseudospark.suite.common import (
    catalog_of,
    mappings,
    namespaces,
    new_store,
    ntz,
    order_store,
    sha,
    table,
)

EPOCH = "2024-01-01 00:00:00"


def store_scan(spark, sf):
    rows = order_store(spark, sf).read()
    return rows.select("namespace_name", "original_value", "pseudonym_value", ntz("created_at"))


def _seeded(spark, sf, **options):
    """A store that already knows the customers of one market segment, under pseudonyms of its own."""
    customer = table(spark, sf, "customer")
    store = new_store(spark, **options)
    known = customer.where(F.col("c_mktsegment") == "BUILDING")
    pseudonym = F.concat(F.lit("seed-"), F.col("c_custkey"))
    store.seed(mappings(known, F.lit("people"), F.col("c_name"), pseudonym, F.lit(EPOCH)), "seed")
    return store, customer


def _people(customer):
    return customer.select(F.lit("people").alias("namespace_name"), F.col("c_name").alias("original_value"))


def upsert_misses(spark, sf):
    store, customer = _seeded(spark, sf)
    return pick_misses(_people(customer), store.read()).select("original_value")


def upsert_union(spark, sf):
    store, customer = _seeded(spark, sf)
    done = store.upsert(_people(customer), namespaces(spark, people=("Sha256HexEncoded", 64)))
    return done.mappings.select("original_value", "pseudonym_value", "is_new")


def upsert_shuffled(spark, sf):
    """As ``upsert_union``, with requests that do not fit a broadcast."""
    store, customer = _seeded(spark, sf, broadcast_bytes=0)
    done = store.upsert(_people(customer), namespaces(spark, people=("Sha256HexEncoded", 64)))
    return done.mappings.select("original_value", "pseudonym_value", "is_new")


def seed_twice(spark, sf):
    """A second import under the same name, of all customers, adds those that the first did not hold."""
    store, customer = _seeded(spark, sf)
    pseudonym = F.concat(F.lit("later-"), F.col("c_custkey"))
    store.seed(mappings(customer, F.lit("people"), F.col("c_name"), pseudonym, F.lit(EPOCH)), "seed")
    return store.read().select("namespace_name", "original_value", "pseudonym_value")


def upsert_first_wins(spark, sf):
    """A hash namespace whose store holds other pseudonyms: the stored ones win for all orders."""
    store, customer = _seeded(spark, sf)
    orders = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    df = orders.select("o_orderkey", "c_name")
    catalog = namespaces(spark, people=("Sha256HexEncoded", 64))
    return pseudonymize(df, [ColumnMapping("c_name", "people")], catalog, store).df


def upsert_idempotent(spark, sf):
    """Random pseudonyms asked for twice, then once more as a retry of the first batch: nothing changes."""
    requests = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("namespace_name"), F.col("o_custkey").cast("string").alias("original_value")
    )
    catalog = catalog_of(requests, "namespace_name", "Uuid4", 36)
    store = new_store(spark)
    keys = ["namespace_name", "original_value"]
    rounds = [store.upsert(requests, catalog, batch).mappings for batch in ("first", "second", "first")]
    first, second, third = [
        r.select(*keys, F.col("pseudonym_value").alias(f"p{i}")) for i, r in enumerate(rounds)
    ]
    both = first.join(second, keys, "full").join(third, keys, "full")
    same = F.coalesce((F.col("p0") == F.col("p1")) & (F.col("p1") == F.col("p2")), F.lit(False))
    counted = both.agg(F.count(F.lit(1)).alias("n"), F.sum((~same).cast("long")).alias("n_changed"))
    return counted.withColumn("n_stored", store.read().agg(F.count(F.lit(1))).scalar())


def upsert_covers_all(spark, sf):
    store, customer = _seeded(spark, sf)
    store.upsert(_people(customer), namespaces(spark, people=("FullRandomHexEncoded", 20)))
    left = checks.uncovered(_people(customer), store.read())
    return left.agg(F.count(F.lit(1)).alias("n_uncovered"))


def compacted(spark, sf):
    """Two batches rewritten as one."""
    store, customer = _seeded(spark, sf)
    store.upsert(_people(customer), namespaces(spark, people=("Sha256HexEncoded", 64)))
    store.compact()
    return store.read().select("namespace_name", "original_value", "pseudonym_value")


def list_summary(spark, sf):
    rows = lookup.summary(order_store(spark, sf).read())
    return rows.select("namespace_name", "pseudonym", ntz("created_at"), ntz("last_updated_at"))


def _page_columns(rows):
    return rows.select("namespace_name", "pseudonym", ntz("created_at"), ntz("last_updated_at"))


def page_first(spark, sf):
    return _page_columns(lookup.stored_page(order_store(spark, sf), "1-URGENT").items)


def page_keyset(spark, sf):
    store = order_store(spark, sf)
    at = spark.sql("SELECT timestamp'1996-01-01 00:00:00' AS at").first()["at"]
    return _page_columns(lookup.stored_page(store, "1-URGENT", lookup.Cursor(at, "5"), 40).items)


def page_next(spark, sf):
    """The third page, reached by following cursors."""
    store = order_store(spark, sf)
    cursor = None
    for _ in range(2):
        cursor = lookup.stored_page(store, "2-HIGH", cursor, 10).next_cursor
    return _page_columns(lookup.stored_page(store, "2-HIGH", cursor, 10).items)


def page_sweep(spark, sf):
    store = order_store(spark, sf)
    swept = lookup.page_sweep(store.read(), 25, store.workspace)
    return swept.select("namespace_name", "pseudonym", ntz("created_at"), "row_number", "page")


def count_one(spark, sf):
    return lookup.count_one(order_store(spark, sf).read(), "3-MEDIUM")


def count_by_namespace(spark, sf):
    return lookup.count_by_namespace(order_store(spark, sf).read())


def _short_pseudonyms(spark, sf):
    """Orders under two-digit pseudonyms, so that many orders share one."""
    return mappings(
        table(spark, sf, "orders"),
        F.col("o_orderpriority"),
        F.col("o_orderkey"),
        F.substring(sha(F.col("o_custkey").cast("string")), 1, 2),
        F.col("o_orderdate"),
    )


SHORT_SQL = """
    SELECT o_orderpriority AS namespace_name, CAST(o_orderkey AS VARCHAR) AS original_value,
           substr(upper(sha256(CAST(o_custkey AS VARCHAR))), 1, 2) AS pseudonym_value, o_orderdate AS created_at
    FROM orders
"""


def reverse_lookup(spark, sf):
    store = new_store(spark)
    store.seed(_short_pseudonyms(spark, sf), "short")
    requests = _short_pseudonyms(spark, sf).select("namespace_name", "pseudonym_value")
    found = store.reverse_many(requests)
    return found.select("namespace_name", "pseudonym_value", "original_value", ntz("created_at"))


def reverse_point(spark, sf):
    store = new_store(spark)
    store.seed(_short_pseudonyms(spark, sf), "short")
    found = store.reverse_one("5-LOW", "A6")
    return found.select("namespace_name", "pseudonym_value", "original_value", ntz("created_at"))


def cascade_delete(spark, sf):
    """One namespace leaves both tables."""
    store = order_store(spark, sf)
    catalog = catalog_of(table(spark, sf, "orders"), "o_orderpriority", "Sha256HexEncoded", 64)
    store.delete_namespace("2-HIGH")
    kept_catalog, _ = without_namespace(["2-HIGH"], catalog, store.read())
    counts = lookup.count_by_namespace(store.read())
    return kept_catalog.select(F.col("name").alias("namespace_name")).join(counts, "namespace_name", "full")


def _loose_mappings(spark, sf):
    """Events as a mapping table without any constraint."""
    return mappings(
        table(spark, sf, "events"),
        F.col("event_type"),
        F.col("user_id"),
        F.when(F.col("value") >= 10, F.substring(sha(F.col("user_id").cast("string")), 1, 2)),
        F.col("ts"),
    )


LOOSE_SQL = """
    SELECT event_type AS namespace_name, CAST(user_id AS VARCHAR) AS original_value,
           CASE WHEN value >= 10 THEN substr(upper(sha256(CAST(user_id AS VARCHAR))), 1, 2) END AS pseudonym_value,
           ts AS created_at
    FROM events
"""


def check_unique(spark, sf):
    return checks.duplicate_keys(_loose_mappings(spark, sf))


def check_orphans(spark, sf):
    """Customers kept under their nation, checked against a catalogue of the suppliers' nations in good standing."""
    nation = table(spark, sf, "nation")
    suppliers = table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000)
    catalog = catalog_of(
        suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "n_name", "Uuid4", 36
    )
    people = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    stored = mappings(people, F.col("n_name"), F.col("c_name"), sha(F.col("c_name")), F.lit(EPOCH))
    return checks.orphans(stored, catalog).select("namespace_name", "original_value")


def check_ambiguous(spark, sf):
    return checks.ambiguous_pseudonyms(_loose_mappings(spark, sf))


def check_nulls(spark, sf):
    return checks.null_counts(_loose_mappings(spark, sf))


QUERIES = {
    "store_scan": store_scan,
    "upsert_misses": upsert_misses,
    "upsert_union": upsert_union,
    "upsert_shuffled": upsert_shuffled,
    "seed_twice": seed_twice,
    "upsert_first_wins": upsert_first_wins,
    "upsert_idempotent": upsert_idempotent,
    "upsert_covers_all": upsert_covers_all,
    "store_compacted": compacted,
    "list_summary": list_summary,
    "page_first": page_first,
    "page_keyset": page_keyset,
    "page_next": page_next,
    "page_sweep": page_sweep,
    "count_one": count_one,
    "count_by_namespace": count_by_namespace,
    "reverse_lookup": reverse_lookup,
    "reverse_point": reverse_point,
    "cascade_delete": cascade_delete,
    "check_unique": check_unique,
    "check_orphans": check_orphans,
    "check_ambiguous": check_ambiguous,
    "check_nulls": check_nulls,
}

ORDERS_SQL = """
    SELECT o_orderpriority AS namespace_name, CAST(o_orderkey AS VARCHAR) AS original_value,
           upper(sha256(CAST(o_orderkey AS VARCHAR))) AS pseudonym_value, o_orderdate AS created_at
    FROM orders
"""
LIST_SQL = "SELECT namespace_name, pseudonym_value AS pseudonym, created_at, created_at AS last_updated_at"
PEOPLE_SQL = """
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'seed-' || CAST(c_custkey AS VARCHAR) ELSE upper(sha256(c_name)) END
"""
UNION_SQL = f"""
    SELECT c_name AS original_value, {PEOPLE_SQL} AS pseudonym_value, c_mktsegment <> 'BUILDING' AS is_new
    FROM customer
"""

ORACLE = {
    "store_scan": ORDERS_SQL,
    "upsert_misses": "SELECT c_name AS original_value FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "upsert_union": UNION_SQL,
    "upsert_shuffled": UNION_SQL,
    "seed_twice": """
        SELECT 'people' AS namespace_name, c_name AS original_value,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'seed-' ELSE 'later-' END || CAST(c_custkey AS VARCHAR)
                   AS pseudonym_value
        FROM customer
    """,
    "upsert_first_wins": f"""
        SELECT o_orderkey, {PEOPLE_SQL} AS c_name FROM orders JOIN customer ON o_custkey = c_custkey
    """,
    "upsert_idempotent": """
        SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_changed, count(*) AS n_stored
        FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)
    """,
    "upsert_covers_all": "SELECT CAST(0 AS BIGINT) AS n_uncovered",
    "store_compacted": f"""
        SELECT 'people' AS namespace_name, c_name AS original_value, {PEOPLE_SQL} AS pseudonym_value FROM customer
    """,
    "list_summary": f"{LIST_SQL} FROM ({ORDERS_SQL})",
    "page_first": f"""
        {LIST_SQL} FROM ({ORDERS_SQL}) WHERE namespace_name = '1-URGENT'
        ORDER BY created_at DESC, original_value DESC LIMIT 25
    """,
    "page_keyset": f"""
        {LIST_SQL} FROM ({ORDERS_SQL})
        WHERE namespace_name = '1-URGENT' AND (created_at, original_value) < (TIMESTAMP '1996-01-01', '5')
        ORDER BY created_at DESC, original_value DESC LIMIT 40
    """,
    "page_next": f"""
        {LIST_SQL} FROM ({ORDERS_SQL}) WHERE namespace_name = '2-HIGH'
        ORDER BY created_at DESC, original_value DESC LIMIT 10 OFFSET 20
    """,
    "page_sweep": f"""
        SELECT namespace_name, pseudonym, created_at, row_number, CAST(ceil(row_number / 25.0) AS BIGINT) AS page
        FROM (SELECT namespace_name, pseudonym_value AS pseudonym, created_at,
                     row_number() OVER (PARTITION BY namespace_name ORDER BY created_at DESC, original_value DESC)
                         AS row_number
              FROM ({ORDERS_SQL}))
    """,
    "count_one": "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '3-MEDIUM'",
    "count_by_namespace": "SELECT o_orderpriority AS namespace_name, count(*) AS n FROM orders GROUP BY ALL",
    "reverse_lookup": f"""
        SELECT namespace_name, pseudonym_value, original_value, created_at FROM ({SHORT_SQL})
        QUALIFY row_number() OVER (
            PARTITION BY namespace_name, pseudonym_value ORDER BY created_at, original_value) = 1
    """,
    "reverse_point": f"""
        SELECT namespace_name, pseudonym_value, original_value, created_at FROM ({SHORT_SQL})
        WHERE namespace_name = '5-LOW' AND pseudonym_value = 'A6' ORDER BY created_at, original_value LIMIT 1
    """,
    "cascade_delete": """
        SELECT o_orderpriority AS namespace_name, count(*) AS n FROM orders
        WHERE o_orderpriority <> '2-HIGH' GROUP BY ALL
    """,
    "check_unique": f"""
        SELECT namespace_name, original_value, count(*) AS n FROM ({LOOSE_SQL}) GROUP BY ALL HAVING count(*) > 1
    """,
    "check_orphans": """
        SELECT n_name AS namespace_name, c_name AS original_value
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
    """,
    "check_ambiguous": f"""
        SELECT namespace_name, pseudonym_value FROM ({LOOSE_SQL}) WHERE pseudonym_value IS NOT NULL
        GROUP BY ALL HAVING count(DISTINCT original_value) > 1
    """,
    "check_nulls": f"""
        SELECT count(*) - count(namespace_name) AS namespace_name_nulls,
               count(*) - count(original_value) AS original_value_nulls,
               count(*) - count(pseudonym_value) AS pseudonym_value_nulls,
               count(*) - count(created_at) AS created_at_nulls,
               count(*) - count(created_at) AS last_updated_at_nulls
        FROM ({LOOSE_SQL})
    """,
}
