"""The operations of a caller with roles: access is checked, then the work is done."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudospark.operators import jobs, lookup
from pseudospark.operators.access import accessible, denied_job_namespaces, is_admin
from pseudospark.operators.catalog import NamespaceCatalog
from pseudospark.operators.store import MappingStore, Upserted
from pseudospark.plans.csv_job import CsvJobResult
from pseudospark.plans.job_run import JobLedger, run_recorded
from pseudospark.sources import files
from pseudospark.plans.transform import (
    ColumnMapping,
    Result,
    column_position,
    depseudonymize,
    pseudonymize,
    split_blank,
    usable_mappings,
)
from pseudospark.schemas import FORBIDDEN, NOT_FOUND


class ForbiddenError(Exception):
    """The caller lacks a permission."""


class NotFoundError(Exception):
    """A namespace or a job does not exist."""


@dataclass(frozen=True)
class Caller:
    subject: str
    roles: Sequence[str] = ()


@dataclass(frozen=True)
class Guard:
    """Catalogue and store behind the access rules."""

    catalog: NamespaceCatalog
    store: MappingStore
    rules: DataFrame
    admin_roles: Sequence[str] = ()
    enabled: bool = True

    # -- checks ------------------------------------------------------------------------------------------------------

    def is_admin(self, caller: Caller) -> bool:
        return is_admin(caller.roles, self.admin_roles, self.enabled)

    def _allowed(self, caller: Caller, permission: str, df: DataFrame, column: str) -> DataFrame:
        return accessible(df, column, self.rules, caller.roles, permission, self.admin_roles, self.enabled)

    def _require_admin(self, caller: Caller) -> None:
        if not self.is_admin(caller):
            raise ForbiddenError("Only an admin creates or deletes namespaces.")

    def _require(self, caller: Caller, permission: str, names: DataFrame) -> None:
        """Fail with the first name (in order) that the caller may not use."""
        distinct = names.distinct()
        denied = distinct.join(self._allowed(caller, permission, distinct, "name"), "name", "left_anti")
        first = denied.agg(F.min("name").alias("name")).first()["name"]
        if first is not None:
            label = permission.replace("_", "-").capitalize()
            raise ForbiddenError(FORBIDDEN.format(permission=label, namespace=first))

    def _one(self, name: str) -> DataFrame:
        return self.store.spark.createDataFrame([(name,)], "name string")

    def _require_known(self, name: str) -> DataFrame:
        found = self.catalog.get(name)
        if found.isEmpty():
            raise NotFoundError(NOT_FOUND.format(namespace=name))
        return found

    # -- namespaces --------------------------------------------------------------------------------------------------

    def create_namespace(self, caller: Caller, **definition) -> None:
        self._require_admin(caller)
        self.catalog.create(**definition)

    def delete_namespace(self, caller: Caller, name: str) -> None:
        self._require_admin(caller)
        self._require_known(name)
        self.catalog.delete(name, self.store)

    def get_namespace(self, caller: Caller, name: str) -> DataFrame:
        """Existence is judged before access."""
        found = self._require_known(name)
        self._require(caller, "read", self._one(name))
        return found

    def namespaces(self, caller: Caller) -> DataFrame:
        """The namespaces that the caller may read."""
        return self._allowed(caller, "read", self.catalog.load(), "name")

    # -- pseudonyms --------------------------------------------------------------------------------------------------

    def create(self, caller: Caller, requests: DataFrame, batch_id: str | None = None) -> Upserted:
        """Pseudonyms for (``namespace_name``, ``original_value``); access is judged before existence."""
        self._require(caller, "write", requests.select(F.col("namespace_name").alias("name")))
        _, blank = split_blank(requests)
        if not blank.isEmpty():
            raise ValueError("Blank values get no pseudonym.")
        return self.store.upsert(requests, self.catalog.load(), batch_id)

    def page(
        self, caller: Caller, name: str, cursor: lookup.Cursor | None = None, size: int = 0, with_total: bool = False
    ) -> lookup.Page:
        """One page of a namespace, without originals; existence is judged before access."""
        self._require_known(name)
        self._require(caller, "read", self._one(name))
        return lookup.stored_page(self.store, name, cursor, size, with_total)

    def reverse(self, caller: Caller, name: str, pseudonym: str) -> DataFrame:
        """The mapping behind a pseudonym or no row. A namespace that does not exist has no mappings."""
        self._require(caller, "reverse_lookup", self._one(name))
        return self.store.reverse_one(name, pseudonym)

    # -- tables ------------------------------------------------------------------------------------------------------

    def _require_mapped(
        self, caller: Caller, permission: str, df: DataFrame, mappings: Sequence[ColumnMapping]
    ) -> None:
        """Check all namespaces that the mappings or the table name, also where the value itself is missing."""
        positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
        usable = usable_mappings(mappings)
        fixed = [(m.namespace,) for m in usable if m.namespace_column is None]
        self._require(caller, permission, self.store.spark.createDataFrame(fixed, "name string"))
        for column in {m.namespace_column for m in usable if m.namespace_column is not None}:
            named = F.col(f"_c{column_position(column, df.columns)}").cast("string")
            names = positional.select(named.alias("name")).where("name IS NOT NULL").distinct()
            denied = names.join(self._allowed(caller, permission, names, "name"), "name", "left_anti").count()
            if denied:  # their names are cell contents
                raise ForbiddenError(f"Access to {denied} namespaces that the data name is required.")

    def pseudonymize(
        self, caller: Caller, df: DataFrame, mappings: Sequence[ColumnMapping], batch_id: str | None = None
    ) -> Result:
        self._require_mapped(caller, "write", df, mappings)
        return pseudonymize(df, mappings, self.catalog.load(), self.store, batch_id=batch_id)

    def depseudonymize(self, caller: Caller, df: DataFrame, mappings: Sequence[ColumnMapping]) -> Result:
        self._require_mapped(caller, "reverse_lookup", df, mappings)
        return depseudonymize(df, mappings, self.catalog.load(), self.store)

    # -- jobs --------------------------------------------------------------------------------------------------------

    def check_job(self, caller: Caller, job: DataFrame) -> None:
        """Fail unless the caller may run the job (``id``, ``direction``, ``column_mappings``)."""
        if self.is_admin(caller):
            return
        roles = F.array(*[F.lit(r) for r in caller.roles]).cast("array<string>")
        denied = denied_job_namespaces(job.withColumn("roles", roles), self.rules)
        first = denied.agg(F.min(F.struct("namespace", "permission")).alias("first")).first()["first"]
        if first is not None:
            label = first["permission"].replace("_", "-").capitalize()
            raise ForbiddenError(FORBIDDEN.format(permission=label, namespace=first["namespace"]))

    def job(self, caller: Caller, table: DataFrame, job_id: str) -> DataFrame:
        """One job of the caller's own, or any for an admin; existence is judged before ownership."""
        found = table.where(F.col("id") == job_id)
        row = found.select(jobs.may_access(caller.subject, self.is_admin(caller)).alias("own")).first()
        if row is None:
            raise NotFoundError("There is no such job.")
        if not row["own"]:
            raise ForbiddenError("The job is not the caller's.")
        return found

    def queue_job(self, caller: Caller, table: DataFrame, job_id: str, ledger: JobLedger, root: str) -> int:
        """Queue a job of the table, if the caller may run it and its input is there. Returns the input's size in bytes."""
        job = self.job(caller, table, job_id)
        self.check_job(caller, job)
        path = _under(root, job.first()["input_object_key"])
        if not files.exists(self.store.spark, path):
            raise ValueError("The job's input has not been uploaded.")
        size = files.size(self.store.spark, path)
        ledger.append(job_id, "queue", total_bytes=size)
        return size

    def cancel_job(self, caller: Caller, table: DataFrame, job_id: str, ledger: JobLedger) -> None:
        """Cancel a job; one that runs is stopped at its next sign of life."""
        self.job(caller, table, job_id)
        ledger.append(job_id, "cancel")

    def run_job(
        self, caller: Caller, table: DataFrame, job_id: str, ledger: JobLedger, root: str, **options
    ) -> CsvJobResult | None:
        """Run one job as its own row says, if the caller may and it has not ended, and record what became of it.

        Input, output, delimiter, encoding, header, columns and direction are those of the row; ``root`` is the folder that
        object keys stand under. Without an output key the result lies beside the input, under the job's output name.
        """
        job = self.job(caller, table, job_id)
        self.check_job(caller, job)
        row = job.select("*", jobs.output_name().alias("__name")).first()
        mappings = [
            ColumnMapping(m["source_column"], m["namespace"], m["target_column"]) for m in row["column_mappings"]
        ]
        source = row["input_object_key"]
        target = row["output_object_key"] or "/".join([*source.split("/")[:-1], job_id, row["__name"]])
        return run_recorded(
            self.store.spark, ledger, job_id, _under(root, source), _under(root, target),
            mappings, row["direction"], self.catalog.load(), self.store,
            sep=row["delimiter"], header=row["has_header_row"], encoding=row["encoding"], **options,
        )

    def jobs(self, caller: Caller, table: DataFrame) -> DataFrame:
        return jobs.visible_jobs(table, caller.subject, self.is_admin(caller))

    def clear_jobs(self, caller: Caller, table: DataFrame) -> tuple[DataFrame, DataFrame]:
        return jobs.clear_finished(table, caller.subject, self.is_admin(caller))


def _under(root: str, key: str) -> str:
    """The path of an object key; a key cannot leave the folder."""
    if not key or key.startswith("/") or ".." in key.split("/") or "://" in key:
        raise ValueError("The job's object key is not a path below its folder.")
    return f"{root.rstrip('/')}/{key}"
