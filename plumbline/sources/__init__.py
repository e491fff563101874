"""Reading and writing: files, typed rows, materialized views, system tables."""
