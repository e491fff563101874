"""Relational operators that Spark SQL lacks or spells differently, as compositions of DataFrame operations."""
