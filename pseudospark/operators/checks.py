"""Integrity checks of a mapping table. Each returns the offending rows or counts; all combine before they shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudospark.operators.catalog import unknown_namespaces
from pseudospark.operators.resolve import broadcast_if_small
from pseudospark.schemas import PSEUDONYM_COLUMNS


def duplicate_keys(mappings: DataFrame) -> DataFrame:
    """(namespace, original) stored more than once: two writers were at work."""
    return (
        mappings.groupBy("namespace_name", "original_value")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def orphans(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mappings whose namespace is not in the catalogue."""
    unknown = unknown_namespaces(mappings, catalog)
    return mappings.join(broadcast_if_small(unknown, "namespace_name"), "namespace_name", "left_semi")


def ambiguous_pseudonyms(mappings: DataFrame) -> DataFrame:
    """Pseudonyms that stand for more than one original of a namespace."""
    return (
        mappings.where(F.col("pseudonym_value").isNotNull())
        .groupBy("namespace_name", "pseudonym_value")
        .agg(F.min("original_value").alias("first_original"), F.max("original_value").alias("last_original"))
        .where(F.col("first_original") != F.col("last_original"))
        .select("namespace_name", "pseudonym_value")
    )


def null_counts(mappings: DataFrame, columns=PSEUDONYM_COLUMNS) -> DataFrame:
    """How many nulls each mandatory column holds."""
    return mappings.agg(
        *[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(f"{c}_nulls") for c in columns]
    )


def uncovered(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """Requested keys without a mapping; empty after a complete upsert."""
    keys = ["namespace_name", "original_value"]
    return requests.select(*keys).distinct().join(mappings.select(*keys), keys, "left_anti")
