"""FHIR ``Parameters`` documents in and out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudospark.functions.text import is_blank
from pseudospark.schemas import FHIR_PARAMETERS_SCHEMA, FORBIDDEN, MALFORMED, NOT_FOUND, UNUSABLE


def _value(parameters: Column, name: str) -> Column:
    named = F.filter(parameters, lambda p: p["name"] == name)
    return F.try_element_at(named, F.lit(1))["valueString"]


def parse_parameters(df: DataFrame, column: str) -> DataFrame:
    """Add ``namespace_name``, ``original_value`` and whether the document was a ``Parameters`` resource at all."""
    document = F.from_json(F.col(column), FHIR_PARAMETERS_SCHEMA)
    parsed = df.withColumn("__document", document)
    parameters = F.col("__document.parameter")
    return (
        parsed.withColumn("well_formed", F.coalesce(F.col("__document.resourceType") == "Parameters", F.lit(False)))
        .withColumn("namespace_name", F.when(F.col("well_formed"), _value(parameters, "namespace")))
        .withColumn("original_value", F.when(F.col("well_formed"), _value(parameters, "originalValue")))
        .drop("__document")
    )


def diagnostics(writable: Column, known: Column) -> Column:
    """Why a parsed request fails, or null. Access is judged before the namespace is looked up."""
    name = F.col("namespace_name")

    def naming(message: str) -> Column:
        before, after = message.split("{namespace}")
        return F.concat(F.lit(before), name, F.lit(after))

    unusable = name.isNull() | is_blank(F.col("original_value"))
    return (
        F.when(~F.col("well_formed"), F.lit(MALFORMED))
        .when(unusable, F.lit(UNUSABLE))
        .when(~writable, naming(FORBIDDEN.replace("{permission}", "Write")))
        .when(~known, naming(NOT_FOUND))
    )


def status_code(writable: Column, known: Column) -> Column:
    """200, or the code that goes with the diagnostics."""
    unusable = F.col("namespace_name").isNull() | is_blank(F.col("original_value"))
    return (
        F.when(~F.col("well_formed") | unusable, F.lit(400))
        .when(~writable, F.lit(403))
        .when(~known, F.lit(404))
        .otherwise(F.lit(200))
    )


def operation_outcome(message: Column, code: Column) -> Column:
    """The error document of a failed request."""
    issue = F.struct(
        F.lit("error").alias("severity"),
        F.when(code == 403, "forbidden").otherwise("processing").alias("code"),
        message.alias("diagnostics"),
    )
    return F.to_json(F.struct(F.lit("OperationOutcome").alias("resourceType"), F.array(issue).alias("issue")))


def parameters_reply(namespace: Column, original: Column, pseudonym: Column) -> Column:
    """The reply document: namespace, original and pseudonym in this order."""

    def parameter(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("valueString"))

    listed = F.array(
        parameter("namespace", namespace),
        parameter("originalValue", original),
        parameter("pseudonymValue", pseudonym),
    )
    return F.to_json(F.struct(F.lit("Parameters").alias("resourceType"), listed.alias("parameter")))
