"""Who may do what in which namespace.

A rule names a namespace, or ``*`` for all, and the roles that may read, write or look up originals there. A caller has
access if one of its roles is granted by any matching rule.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudospark.operators.resolve import broadcast_if_small
from pseudospark.schemas import DEPSEUDONYMIZE

EVERY = "*"
PERMISSIONS = {"read": "read_roles", "write": "write_roles", "reverse_lookup": "reverse_lookup_roles"}


def is_admin(roles: Sequence[str], admin_roles: Sequence[str], enabled: bool = True) -> bool:
    """Without access control everybody is an admin."""
    return not enabled or bool(set(roles) & set(admin_roles))


def role_grants(rules: DataFrame) -> DataFrame:
    """Distinct (namespace, permission, role) of all rules."""
    entries = [
        F.struct(F.lit(p).alias("permission"), F.col(c).alias("roles")) for p, c in PERMISSIONS.items()
    ]
    return (
        rules.select("namespace", F.explode(F.array(*entries)).alias("entry"))
        .select("namespace", "entry.permission", F.explode("entry.roles").alias("role"))
        .distinct()
    )


def granted_namespaces(rules: DataFrame, roles: Sequence[str], permission: str) -> DataFrame:
    """Namespaces (or ``*``) on which a caller with ``roles`` has the permission."""
    return (
        rules.where(F.arrays_overlap(F.col(PERMISSIONS[permission]), F.array(*[F.lit(r) for r in roles])))
        .select("namespace")
        .distinct()
    )


def accessible(
    df: DataFrame,
    column: str,
    rules: DataFrame,
    roles: Sequence[str],
    permission: str,
    admin_roles: Sequence[str] = (),
    enabled: bool = True,
) -> DataFrame:
    """Rows of ``df`` whose namespace the caller may access.

    The wildcard is one boolean, the rest an equi semi-join; no pair of row and rule is formed.
    """
    if is_admin(roles, admin_roles, enabled):
        return df
    if not roles:
        return df.where(F.lit(False))
    granted = granted_namespaces(rules, roles, permission)
    if not granted.where(F.col("namespace") == EVERY).isEmpty():
        return df
    own = granted.select(F.col("namespace").alias("__granted"))
    own = broadcast_if_small(own, "__granted")
    return df.join(own, F.col(column) == F.col("__granted"), "left_semi")


def effective_roles(names: DataFrame, rules: DataFrame, column: str = "name") -> DataFrame:
    """Per namespace the sorted, distinct roles of its own and the wildcard rules, for each permission."""
    # The grants are distinct, so a set holds each role of a namespace once however many rules repeat it.
    role_sets = [
        F.collect_set(F.when(F.col("permission") == p, F.col("role"))).alias(f"__{p}") for p in PERMISSIONS
    ]
    grants = role_grants(rules)
    own = grants.where(F.col("namespace") != EVERY).groupBy("namespace").agg(*role_sets)
    wildcard = grants.where(F.col("namespace") == EVERY)
    result = names.select(column).join(
        broadcast_if_small(own, "namespace"), F.col(column) == F.col("namespace"), "left"
    )
    nobody = F.array().cast("array<string>")
    columns = []
    for permission, name in PERMISSIONS.items():
        # One row of roles, computed once and inlined.
        everywhere = wildcard.where(F.col("permission") == permission).agg(F.collect_set("role")).scalar()
        merged = F.array_union(F.coalesce(f"__{permission}", nobody), F.coalesce(everywhere, nobody))
        columns.append(F.sort_array(merged).alias(name))
    return result.select(column, *columns)


def denied_job_namespaces(jobs: DataFrame, rules: DataFrame, admin_roles: Sequence[str] = ()) -> DataFrame:
    """(job, namespace, permission) that stop a job from being created.

    ``jobs`` has ``id``, ``direction``, ``column_mappings`` and the creator's ``roles``. Pseudonymizing needs write access
    to every namespace used, the reverse needs reverse-lookup access.
    """
    permission = F.when(F.col("direction") == DEPSEUDONYMIZE, "reverse_lookup").otherwise("write")
    admin = F.arrays_overlap("roles", F.array(*[F.lit(r) for r in admin_roles]).cast("array<string>"))
    needed = (
        jobs.where(~F.coalesce(admin, F.lit(False)))
        .select("id", permission.alias("permission"), "roles", F.explode("column_mappings").alias("m"))
        .select("id", "permission", "roles", F.col("m.namespace").alias("namespace"))
        .distinct()
    )
    grants = role_grants(rules)
    claims = needed.select("id", "namespace", "permission", F.explode("roles").alias("role")).withColumn(
        "__rule", F.explode(F.array(F.col("namespace"), F.lit(EVERY)))
    )
    small = broadcast_if_small(
        grants.select(F.col("namespace").alias("__rule"), "permission", "role"), "__rule", "permission", "role"
    )
    allowed = claims.join(small, ["__rule", "permission", "role"], "left_semi")
    keys = ["id", "namespace", "permission"]
    return needed.select(*keys).join(allowed.select(*keys), keys, "left_anti")
