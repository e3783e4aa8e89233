"""Small helpers of the operators: reading input tables and joining by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from pseudospark.sources.files import Workspace

#: Most rows of a narrow table (a few numbers or one short text each) that are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Most bytes of such a table, as JSON text, where its columns are not plain numbers.
BROADCAST_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved_broadcast(df: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """``df`` written once, with a broadcast hint if its counted rows are few and small enough."""
    table = workspace.save(df, name)
    if table.count() > BROADCAST_ROWS:
        return table
    if not all(_is_narrow(f.dataType) for f in table.schema.fields):
        size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0]
        if (size or 0) > BROADCAST_BYTES:
            return table
    return F.broadcast(table)


def _is_narrow(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free
