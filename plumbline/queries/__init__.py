"""The catalogue of queries: one key for each operator, with the SQL that DuckDB runs for comparison."""

from plumbline.queries import analysis, calls, core, declared, gaps, more, writes
from plumbline.queries._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis", "calls", "core", "declared", "gaps", "more", "writes"]
