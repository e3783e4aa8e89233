"""What the registered queries share: tables, settings and seeded stores."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudospark.operators.store import MappingStore
from pseudospark.schemas import NAMESPACE_SCHEMA
from pseudospark.sources.files import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def namespaces(spark: SparkSession, **settings) -> DataFrame:
    """A catalogue from ``name=(method, length)`` or ``name=(method, length, prefix, suffix)``."""
    rows = [(name, None, *s, *[None] * (4 - len(s)), None, None) for name, s in settings.items()]
    return spark.createDataFrame(rows, NAMESPACE_SCHEMA)


def catalog_of(names: DataFrame, column: str, method: str, length: int, prefix=None) -> DataFrame:
    """A catalogue with one namespace per distinct value of a column."""
    none = F.lit(None)
    return (
        names.select(F.col(column).alias("name"))
        .distinct()
        .select(
            "name",
            none.cast("string").alias("description"),
            F.lit(method).alias("pseudonym_generation_method"),
            F.lit(length).cast("long").alias("pseudonym_length"),
            (none.cast("string") if prefix is None else prefix).alias("pseudonym_prefix"),
            none.cast("string").alias("pseudonym_suffix"),
            none.cast("timestamp").alias("created_at"),
            none.cast("timestamp").alias("last_updated_at"),
        )
    )


def new_store(spark: SparkSession, **options) -> MappingStore:
    workspace = Workspace(spark)
    return MappingStore(spark, workspace.path("store"), workspace, **options)


def sha(value: Column) -> Column:
    return F.upper(F.sha2(value, 256))


def mappings(df: DataFrame, namespace, original, pseudonym, created) -> DataFrame:
    """A mapping table out of any table's columns."""
    return df.select(
        namespace.alias("namespace_name"),
        original.cast("string").alias("original_value"),
        pseudonym.alias("pseudonym_value"),
        created.cast("timestamp").alias("created_at"),
        created.cast("timestamp").alias("last_updated_at"),
    )


def order_mappings(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """Every order (of a status) as a mapping: namespace = priority, original = key, created on the order date."""
    orders = table(spark, sf_dir, "orders")
    return mappings(
        orders if status is None else orders.where(F.col("o_orderstatus") == status),
        F.col("o_orderpriority"),
        F.col("o_orderkey"),
        sha(F.col("o_orderkey").cast("string")),
        F.col("o_orderdate"),
    )


def order_store(spark: SparkSession, sf_dir: str) -> MappingStore:
    store = new_store(spark)
    store.seed(order_mappings(spark, sf_dir), "orders")
    return store


def ntz(name: str):
    """Timestamps as plain UTC date and time, whatever the session's time zone type."""
    return F.col(name).cast("timestamp_ntz").alias(name)

