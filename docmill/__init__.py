"""Document collections on Spark: find, update and aggregate as Catalyst plans."""

from docmill.collection import Collection, Database, DestroyedError
from docmill.functions.predicate import QueryError

__all__ = ["Collection", "Database", "DestroyedError", "QueryError"]
