"""Queries: the generators, each run through a bulk upsert."""

from pyspark.sql import functions as F

from pseudospark.functions.generators import GENERATORS, Generator, register_generator
from pseudospark.plans.transform import split_blank
from pseudospark.suite.common import namespaces, new_store, sha, table


def _requests(df, namespace, value):
    return df.select(namespace.alias("namespace_name"), value.cast("string").alias("original_value"))


def gen_sha256(spark, sf):
    """SHA-256 over whole document texts. Blank ones, which no store takes, are hashed beside it; a null text has no hash."""
    docs = table(spark, sf, "documents")
    texts, blank = split_blank(_requests(docs, F.lit("texts"), F.col("text")))
    catalog = namespaces(spark, texts=("Sha256HexEncoded", 64))
    done = new_store(spark).upsert(texts, catalog).mappings.select("original_value", "pseudonym_value")
    rest = blank.select("original_value").distinct().withColumn("pseudonym_value", sha(F.col("original_value")))
    return done.unionByName(rest)


def gen_prefix_suffix(spark, sf):
    requests = _requests(table(spark, sf, "customer"), F.lit("people"), F.col("c_name"))
    catalog = namespaces(spark, people=("Sha256HexEncoded", 64, "pre-", "-suf"))
    return new_store(spark).upsert(requests, catalog).mappings.select("original_value", "pseudonym_value")


def _invariants(method, length, pattern):
    """Generate for all orders; count keys, distinct pseudonyms and those of a wrong shape."""

    def query(spark, sf):
        requests = _requests(table(spark, sf, "orders"), F.lit("orders"), F.col("o_orderkey"))
        catalog = namespaces(spark, orders=(method, length))
        done = new_store(spark).upsert(requests, catalog).mappings
        return done.agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("pseudonym_value").alias("n_distinct"),
            F.sum((~F.col("pseudonym_value").rlike(pattern)).cast("long")).alias("n_bad"),
        )

    return query


INVARIANT_SQL = """
SELECT count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) AS n_distinct, CAST(0 AS BIGINT) AS n_bad
FROM orders
"""


def gen_dispatch(spark, sf):
    """One namespace per event type, each with another method, in one upsert."""
    shapes = {
        "click": (("Sha256HexEncoded", 64), "^[0-9A-F]{64}$"),
        "view": (("Uuid4", 36), "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"),
        "purchase": (("FullRandomHexEncoded", 31), "^[0-9a-f]{31}$"),
        "signup": (("FullRandomBase62Encoded", 16), "^[0-9A-Za-z]{16}$"),
        "error": (("Unspecified", 16), "^[0-9A-Za-z_-]{32}$"),
    }
    catalog = namespaces(spark, **{name: setting for name, (setting, _) in shapes.items()})
    requests = _requests(table(spark, sf, "events"), F.col("event_type"), F.col("user_id"))
    done = new_store(spark).upsert(requests, catalog).mappings
    value = F.col("pseudonym_value")
    good = F.lit(False)
    for name, (_, pattern) in shapes.items():
        fits = value.rlike(pattern)
        if name == "click":
            fits = fits & (value == F.upper(F.sha2("original_value", 256)))
        good = F.when(F.col("namespace_name") == name, fits).otherwise(good)
    return done.groupBy("namespace_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("pseudonym_value").alias("n_distinct"),
        F.sum((~good).cast("long")).alias("n_bad"),
    )


def gen_registered(spark, sf):
    """A method of the caller's own next to a built-in one; a namespace that nobody asks for has an unknown method."""
    if "Reversed" not in GENERATORS:
        register_generator("Reversed", Generator(lambda value, length: F.reverse(value), deterministic=True))
    catalog = namespaces(
        spark,
        view=("Sha256HexEncoded", 64),
        unused=("NoSuchMethod", 8),
        **{name: ("Reversed", 8, "r-") for name in ("click", "purchase", "signup", "error")},
    )
    requests = _requests(table(spark, sf, "events"), F.col("event_type"), F.col("user_id"))
    done = new_store(spark).upsert(requests, catalog).mappings
    return done.select("namespace_name", "original_value", "pseudonym_value")


QUERIES = {
    "gen_sha256": gen_sha256,
    "gen_prefix_suffix": gen_prefix_suffix,
    # 8 fixed and 32 random bytes are 54 base64 digits.
    "gen_base64url": _invariants("SecureRandomBase64UrlEncoded", 32, "^[0-9A-Za-z_-]{54}$"),
    "gen_uuid4": _invariants(
        "Uuid4", 36, "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    ),
    "gen_uuid7": _invariants(
        "Uuid7", 36, "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    ),
    "gen_hex": _invariants("FullRandomHexEncoded", 33, "^[0-9a-f]{33}$"),
    "gen_base62": _invariants("FullRandomBase62Encoded", 17, "^[0-9A-Za-z]{17}$"),
    "gen_dispatch": gen_dispatch,
    "gen_registered": gen_registered,
}

ORACLE = {
    "gen_sha256": """
        SELECT DISTINCT text AS original_value, upper(sha256(text)) AS pseudonym_value FROM documents
    """,
    "gen_prefix_suffix": """
        SELECT DISTINCT c_name AS original_value, 'pre-' || upper(sha256(c_name)) || '-suf' AS pseudonym_value
        FROM customer
    """,
    "gen_base64url": INVARIANT_SQL,
    "gen_uuid4": INVARIANT_SQL,
    "gen_uuid7": INVARIANT_SQL,
    "gen_hex": INVARIANT_SQL,
    "gen_base62": INVARIANT_SQL,
    "gen_registered": """
        SELECT DISTINCT event_type AS namespace_name, CAST(user_id AS VARCHAR) AS original_value,
               CASE event_type WHEN 'view' THEN upper(sha256(CAST(user_id AS VARCHAR)))
                    ELSE 'r-' || reverse(CAST(user_id AS VARCHAR)) END AS pseudonym_value
        FROM events
    """,
    "gen_dispatch": """
        SELECT event_type AS namespace_name, count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS n_distinct,
               CAST(0 AS BIGINT) AS n_bad
        FROM events GROUP BY event_type
    """,
}
