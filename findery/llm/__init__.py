"""Training-data operators: ten operators, their queries and their SQL.

Nothing else in the library imports this subpackage.  ``QUERIES`` maps each
query name to a callable ``(spark, sf_dir) -> DataFrame``; ``ORACLE_SQL`` has
the DuckDB text of those that SQL can express.
"""

from findery.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
