"""Answering a table of FHIR create requests."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudospark.operators.access import EVERY, granted_namespaces, is_admin
from pseudospark.operators.resolve import broadcast_if_small
from pseudospark.operators.store import MappingStore
from pseudospark.plans.transform import ColumnMapping, pseudonymize
from pseudospark.sources.fhir import (
    diagnostics,
    operation_outcome,
    parameters_reply,
    parse_parameters,
    status_code,
)


def judged_requests(
    requests: DataFrame,
    column: str,
    catalog: DataFrame,
    rules: DataFrame | None = None,
    roles: Sequence[str] = (),
    admin_roles: Sequence[str] = (),
) -> DataFrame:
    """Parsed requests with ``status_code`` and ``diagnostics`` (null where the request is fine).

    What is known and writable is worked out from the catalogue and the rules alone, so the requests are read once.
    """
    named = catalog.select(F.col("name").alias("__asked"), F.lit(True).alias("__known"))
    everywhere = rules is None or is_admin(roles, admin_roles)
    if not everywhere and roles:
        granted = granted_namespaces(rules, roles, "write")
        everywhere = not granted.where(F.col("namespace") == EVERY).isEmpty()
        writable = granted.select(F.col("namespace").alias("__asked"), F.lit(True).alias("__writable"))
        named = named.join(writable, "__asked", "full")
    else:
        named = named.withColumn("__writable", F.lit(False))
    flags = parse_parameters(requests, column).join(
        broadcast_if_small(named, "__asked"), F.col("namespace_name") == F.col("__asked"), "left"
    )
    may_write = F.lit(True) if everywhere else F.coalesce("__writable", F.lit(False))
    exists = F.coalesce("__known", F.lit(False))
    return (
        flags.withColumn("status_code", status_code(may_write, exists))
        .withColumn("diagnostics", diagnostics(may_write, exists))
        .drop("__asked", "__known", "__writable", "well_formed")
    )


def create_pseudonyms(
    requests: DataFrame,
    column: str,
    catalog: DataFrame,
    store: MappingStore,
    rules: DataFrame | None = None,
    roles: Sequence[str] = (),
    admin_roles: Sequence[str] = (),
    batch_id: str | None = None,
) -> DataFrame:
    """Every request with a ``reply``: the pseudonym document, or an outcome that tells what is wrong.

    A bad request fails alone: it asks for no pseudonym, and the others go on.
    """
    judged = judged_requests(requests, column, catalog, rules, roles, admin_roles)
    accepted = F.col("diagnostics").isNull()
    asked = judged.withColumn("__asked", F.when(accepted, F.col("original_value")))
    mapping = ColumnMapping("__asked", target="pseudonym_value", namespace_column="namespace_name")
    answered = pseudonymize(asked, [mapping], catalog, store, placeholders=(), batch_id=batch_id).df
    reply = parameters_reply(F.col("namespace_name"), F.col("original_value"), F.col("pseudonym_value"))
    outcome = operation_outcome(F.col("diagnostics"), F.col("status_code"))
    return answered.drop("__asked").withColumn("reply", F.when(accepted, reply).otherwise(outcome))
