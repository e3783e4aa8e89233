"""Table schemas and coded values."""

from pyspark.sql import types as T

# Generation method codes.
METHOD_CODES = {
    "Unspecified": 0,
    "SecureRandomBase64UrlEncoded": 1,
    "Sha256HexEncoded": 2,
    "Uuid4": 3,
    "Uuid7": 4,
    "FullRandomHexEncoded": 5,
    "FullRandomBase62Encoded": 6,
}

# Job status codes.
STATUS_CODES = {
    "AwaitingUpload": 0,
    "Queued": 1,
    "Running": 2,
    "Completed": 3,
    "Failed": 4,
    "Cancelled": 5,
    "Stalled": 6,
}

# Job direction codes.
PSEUDONYMIZE = 0
DEPSEUDONYMIZE = 1

# Placeholders that count as "no value" next to blank cells.
MISSING_PLACEHOLDERS = ("NA", "NULL")

# Diagnostics of refused requests, with the namespace in braces.
MALFORMED = "Received malformed or missing resource"
UNUSABLE = "namespace and/or originalValue are missing or blank in the Parameters request object"
FORBIDDEN = "{permission} access to namespace '{namespace}' is required."
NOT_FOUND = "the namespace '{namespace}' could not be found."

# Endings of a job's output file, by direction.
OUTPUT_ENDINGS = {PSEUDONYMIZE: "-pseudonymized.csv", DEPSEUDONYMIZE: "-de-pseudonymized.csv"}

NAMESPACE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("pseudonym_generation_method", T.StringType(), False),
        T.StructField("pseudonym_length", T.LongType(), False),
        T.StructField("pseudonym_prefix", T.StringType()),
        T.StructField("pseudonym_suffix", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_updated_at", T.TimestampType()),
    ]
)

# Partition columns last, as Spark returns them.
PSEUDONYM_SCHEMA = T.StructType(
    [
        T.StructField("original_value", T.StringType()),
        T.StructField("pseudonym_value", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_updated_at", T.TimestampType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("namespace_name", T.StringType()),
    ]
)

PSEUDONYM_COLUMNS = [
    "namespace_name",
    "original_value",
    "pseudonym_value",
    "created_at",
    "last_updated_at",
]

COLUMN_MAPPING_TYPE = T.StructType(
    [
        T.StructField("source_column", T.StringType()),
        T.StructField("target_column", T.StringType()),
        T.StructField("namespace", T.StringType()),
    ]
)

JOB_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("direction", T.IntegerType(), False),
        T.StructField("created_by", T.StringType(), False),
        T.StructField("input_object_key", T.StringType(), False),
        T.StructField("output_object_key", T.StringType()),
        T.StructField("original_file_name", T.StringType()),
        T.StructField("encoding", T.StringType(), False),
        T.StructField("delimiter", T.StringType(), False),
        T.StructField("has_header_row", T.BooleanType(), False),
        T.StructField("column_mappings", T.ArrayType(COLUMN_MAPPING_TYPE), False),
        T.StructField("total_bytes", T.LongType(), False),
        T.StructField("bytes_processed", T.LongType(), False),
        T.StructField("rows_processed", T.LongType(), False),
        T.StructField("bad_data_row_count", T.LongType(), False),
        T.StructField("missing_value_count", T.LongType(), False),
        T.StructField("error_message", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("last_updated_at", T.TimestampType(), False),
    ]
)

RULE_SCHEMA = T.StructType(
    [
        T.StructField("namespace", T.StringType(), False),
        T.StructField("read_roles", T.ArrayType(T.StringType())),
        T.StructField("write_roles", T.ArrayType(T.StringType())),
        T.StructField("reverse_lookup_roles", T.ArrayType(T.StringType())),
    ]
)

FHIR_PARAMETERS_SCHEMA = T.StructType(
    [
        T.StructField("resourceType", T.StringType()),
        T.StructField(
            "parameter",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("valueString", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
