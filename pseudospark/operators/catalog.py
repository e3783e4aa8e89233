"""The catalogue of namespaces: validation, creation, lookup and removal."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudospark.functions.generators import fixed_length
from pseudospark.functions.text import is_blank
from pseudospark.operators.resolve import broadcast_if_small
from pseudospark.schemas import NAMESPACE_SCHEMA
from pseudospark.sources import files


def violation(
    name: str = "name",
    method: str = "pseudonym_generation_method",
    length: str = "pseudonym_length",
) -> Column:
    """Why a namespace definition is not acceptable, or null."""
    required = fixed_length(F.col(method))
    return (
        F.when(is_blank(F.col(name)), F.lit("The name is blank."))
        .when(F.coalesce(F.col(length), F.lit(0)) <= 0, F.lit("The length is not positive."))
        .when(
            required.isNotNull() & (F.col(length) != required),
            F.concat(F.col(method), F.lit(" always has length "), required.cast("string"), F.lit(".")),
        )
    )


def validated(definitions: DataFrame) -> DataFrame:
    return definitions.withColumn("violation", violation())


def new_namespaces(definitions: DataFrame, existing: DataFrame, order_by: list[str]) -> DataFrame:
    """Definitions with ``outcome``: 'created', 'exists' (also for a later definition of the same name) or a violation.

    Existing namespaces are never overwritten. ``order_by`` decides which of several equal names comes first; the fold is
    an aggregate, so many copies of one name combine before the shuffle.
    """
    # Definitions that tie in ``order_by`` are told apart by all their columns; copies of one are the same definition.
    rank = F.struct(*order_by, F.to_json(F.struct("*")).alias("__all"))
    checked = validated(definitions).withColumn("__rank", rank)
    rank = F.col("__rank")
    first = (
        checked.where(F.col("violation").isNull())
        .groupBy("name")
        .agg(F.min(rank).alias("__first"))
        .join(existing.select("name"), "name", "left_anti")
    )
    own = broadcast_if_small(first, "name")
    return (
        checked.join(own, "name", "left")
        .withColumn(
            "outcome",
            F.when(F.col("violation").isNotNull(), F.col("violation"))
            .when(F.col("__first") == rank, F.lit("created"))
            .otherwise(F.lit("exists")),
        )
        .drop("violation", "__first", "__rank")
    )


def unknown_namespaces(requests: DataFrame, catalog: DataFrame, column: str = "namespace_name") -> DataFrame:
    """Distinct requested names that the catalogue lacks."""
    names = requests.select(F.col(column).alias("namespace_name")).distinct()
    known = catalog.select(F.col("name").alias("namespace_name"))
    return names.join(broadcast_if_small(known, "namespace_name"), "namespace_name", "left_anti")


def with_namespace(requests: DataFrame, catalog: DataFrame, column: str = "namespace_name") -> DataFrame:
    """Each request with the settings of its own namespace."""
    settings = catalog.select(
        F.col("name").alias("__name"),
        F.col("pseudonym_generation_method").alias("method"),
        F.col("pseudonym_length").alias("length"),
        F.col("pseudonym_prefix").alias("prefix"),
        F.col("pseudonym_suffix").alias("suffix"),
    )
    small = broadcast_if_small(settings, "__name", "method", "prefix", "suffix")
    return requests.join(small, F.col(column) == F.col("__name")).drop("__name")


def without_namespace(names: list[str], catalog: DataFrame, pseudonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the named namespaces were deleted, with all their pseudonyms."""
    return (
        catalog.where(~F.col("name").isin(names)),
        pseudonyms.where(~F.col("namespace_name").isin(names)),
    )


class NamespaceCatalog:
    """A stored catalogue. Each write makes a new complete snapshot, and readers take the newest one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _snapshots(self) -> list[str]:
        return [p.rsplit("/", 1)[0] for p in files.glob(self.spark, f"{self.path}/snapshot-*/_SUCCESS")]

    def load(self) -> DataFrame:
        snapshots = self._snapshots()
        if not snapshots:
            return self.spark.createDataFrame([], NAMESPACE_SCHEMA)
        return self.spark.read.schema(NAMESPACE_SCHEMA).parquet(snapshots[-1])

    def _replace(self, content: DataFrame) -> None:
        target = f"{self.path}/snapshot-{len(self._snapshots()):08d}"
        content.select(*NAMESPACE_SCHEMA.names).write.mode("overwrite").parquet(target)

    def add(self, definitions: DataFrame, order_by: list[str]) -> DataFrame:
        """Store what is acceptable and new; return every definition's outcome."""
        current = self.load()
        outcome = new_namespaces(definitions, current, order_by)
        now = F.current_timestamp()
        created = (
            outcome.where(F.col("outcome") == "created")
            .withColumn("created_at", now)
            .withColumn("last_updated_at", now)
            .select(*NAMESPACE_SCHEMA.names)
            .dropDuplicates(["name"])
        )
        self._replace(current.unionByName(created))
        return outcome

    def init(self, definitions: list[dict]) -> DataFrame:
        """Create each configured namespace unless its name exists."""
        names = [n for n in NAMESPACE_SCHEMA.names if n not in ("created_at", "last_updated_at")]
        rows = [tuple(d.get(n) for n in names) + (i,) for i, d in enumerate(definitions)]
        types = {f.name: f.dataType.simpleString() for f in NAMESPACE_SCHEMA.fields}
        schema = ", ".join(f"{n} {types[n]}" for n in names) + ", position int"
        return self.add(self.spark.createDataFrame(rows, schema), ["position"]).drop("position")

    def create(self, **definition) -> None:
        """Create one namespace or fail."""
        outcome = self.init([definition]).first()["outcome"]
        if outcome == "exists":
            raise ValueError(f"Namespace '{definition['name']}' is taken.")
        if outcome != "created":
            raise ValueError(outcome)

    def get(self, name: str) -> DataFrame:
        return self.load().where(F.col("name") == name)

    def delete(self, name: str, store=None) -> None:
        """Remove a namespace and, through ``store``, its pseudonyms."""
        if self.get(name).isEmpty():
            raise ValueError(f"There is no namespace '{name}'.")
        if store is not None:
            store.delete_namespace(name)
        self._replace(self.load().where(F.col("name") != name))
