"""Registration of queries and their comparison SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def run_sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """Spark SQL whose {names} are the tables of sf_dir."""
    return spark.sql(text, args, **{t: table(spark, sf_dir, t) for t in tables_of(text)})


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose Spark SQL text, or `oracle` where dialects differ, is also DuckDB's."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"


def query(oracle: str | None = None) -> Callable:
    """A query built with DataFrames, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add
