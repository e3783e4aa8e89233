"""One CSV job: read, transform, write, count."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pseudospark.operators.store import MappingStore
from pseudospark.plans.transform import (
    ColumnMapping,
    column_position,
    depseudonymize,
    pseudonymize,
    usable_mappings,
)
from pseudospark.schemas import DEPSEUDONYMIZE, MISSING_PLACEHOLDERS, PSEUDONYMIZE
from pseudospark.sources.csv import read_csv, write_csv


@dataclass(frozen=True)
class CsvJobResult:
    rows_processed: int
    missing_value_count: int
    bad_data_row_count: int | None


def run_csv_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    mappings: Sequence[ColumnMapping],
    direction: int,
    catalog: DataFrame,
    store: MappingStore,
    sep: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    placeholders=MISSING_PLACEHOLDERS,
    multi_line: bool | None = None,
    keep_order: bool = True,
    batch_id: str | None = None,
    on_progress: Callable[..., None] | None = None,
) -> CsvJobResult:
    """Replace or append columns of CSV files.

    Columns are named by exact header text, or by 0-based position without a header. Rows keep their input order unless
    ``keep_order`` is off; a sort is needed only where there are several files or a join had to shuffle. ``on_progress`` is
    told the counters as soon as they are known; it may raise to stop the job.
    """
    if direction not in (PSEUDONYMIZE, DEPSEUDONYMIZE):
        raise ValueError(f"Unknown direction {direction}.")
    table = read_csv(spark, input_path, sep, header, encoding, multi_line)
    tell = on_progress or (lambda **facts: None)
    tell(bad_data_row_count=table.bad_rows)
    bound = [
        ColumnMapping(column_position(m.source, table.header), m.namespace, m.target)
        for m in usable_mappings(mappings)
    ]
    if direction == PSEUDONYMIZE:
        result = pseudonymize(table.df, bound, catalog, store, placeholders, batch_id)
    else:
        result = depseudonymize(table.df, bound, catalog, store, placeholders)

    try:
        tell(missing_value_count=result.missing)
        _write_result(result, table, bound, output_path, keep_order, sep, encoding)
    finally:
        result.release()
    tell(rows_processed=result.rows)
    return CsvJobResult(result.rows, result.missing, table.bad_rows)


def _write_result(result, table, bound, output_path, keep_order, sep, encoding) -> None:
    rows = result.df.toDF(*[f"_o{i}" for i in range(len(result.df.columns))])
    row_number = f"_o{table.width}"  # behind the input fields, before the appended ones
    if keep_order and not (result.order_kept and table.in_order):
        rows = rows.orderBy(row_number)
    names = None
    if table.header is not None:
        spare = [""] * (table.width - len(table.header))
        names = table.header + spare + [m.target for m in bound if m.target is not None]
    write_csv(rows.drop(row_number), output_path, names, sep, encoding)
