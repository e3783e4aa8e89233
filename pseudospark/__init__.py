"""Pseudonymization of columns of large tables and streams, on Spark."""

from pseudospark.operators.catalog import NamespaceCatalog
from pseudospark.operators.store import MappingStore
from pseudospark.plans.transform import ColumnMapping, depseudonymize, pseudonymize
from pseudospark.sources.files import Workspace

__all__ = [
    "ColumnMapping",
    "MappingStore",
    "NamespaceCatalog",
    "Workspace",
    "depseudonymize",
    "pseudonymize",
]
