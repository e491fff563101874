"""COPY, LOAD DATA, typed bulk loads, materialized views, catalogue tables, partitioned parents."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import Catalog
from plumbline.operators import dml
from plumbline.statement import snake


def copy_to(df: DataFrame, path: str, form: str = "csv", header: bool = True) -> None:
    """COPY ... TO."""
    {"csv": lambda: df.write.option("header", header).csv(path), "json": lambda: df.write.json(path), "parquet": lambda: df.write.parquet(path)}[form]()


def copy_from(spark: SparkSession, path: str, schema: str, form: str = "csv", header: bool = True) -> DataFrame:
    """COPY ... FROM: the schema is given, not inferred, so the files are read once; a malformed row is an error."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return {"csv": lambda: reader.option("header", header).csv(path), "json": lambda: reader.json(path), "parquet": lambda: spark.read.schema(schema).parquet(path)}[form]()


def load_data(spark: SparkSession, path: str, schema: str, separator: str = "\t", skip: int = 0) -> DataFrame:
    """MySQL's LOAD DATA: fields by separator, \\N is null, leading lines skipped by header when skip is 1."""
    return spark.read.schema(schema).option("sep", separator).option("nullValue", "\\N").option("header", skip == 1).csv(path)


def outfile(df: DataFrame, path: str, separator: str = "\t") -> None:
    """MySQL's SELECT ... INTO OUTFILE: fields by separator, \\N for null, no header; a folder with one file a task."""
    df.write.option("sep", separator).option("nullValue", "\\N").option("emptyValue", "").option("header", False).csv(path)


#: Formats that `connect` reads by path.
FORMATS = ("csv", "json", "orc", "parquet", "text", "xml")


def connect(spark: SparkSession, form: str, where: str, schema: str | None = None, **options: str) -> DataFrame:
    """A source by format: files by path, or "jdbc" by url. A jdbc read is cut into `numPartitions` by a numeric column if lowerBound and upperBound are given, else it is one task."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if form == "jdbc":
        parts = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
        if parts & set(options) and not parts <= set(options):
            raise ValueError(f"a partitioned read needs all of {', '.join(sorted(parts))}")
        return reader.format("jdbc").option("url", where).load()
    if form not in FORMATS:
        raise ValueError(f"no format {form}")
    return reader.format(form).load(where)


def rows_frame(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """Dataclass instances as a DataFrame, for appends."""
    return spark.createDataFrame([tuple(getattr(r, f.name) for f in dataclasses.fields(r)) for r in rows], schema)


def columns_of(row: type) -> list[str]:
    return [snake(f.name) for f in dataclasses.fields(row)]


def refresh(spark: SparkSession, view: DataFrame, root: str, version: int) -> DataFrame:
    """REFRESH MATERIALIZED VIEW CONCURRENTLY: the new state is written beside the old and swapped in; readers of the old one go on."""
    dml.commit(spark, view, root, version)
    return dml.current(spark, root)


def parent_scan(children: list[DataFrame]) -> DataFrame:
    """A parent with its children: columns by name, those that some lack as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), children)


def partitioned_scan(parts: list[tuple[object, object, DataFrame]], column: str, low: object = None, high: object = None) -> DataFrame:
    """A range-partitioned parent kept to low <= column < high: partitions (from, to, rows), None for an open end, whose bounds lie outside aren't read at all."""
    kept = [df for a, b, df in parts if (high is None or a is None or a < high) and (low is None or b is None or b > low)]
    rows = parent_scan(kept) if kept else parts[0][2].limit(0)
    if low is not None:
        rows = rows.filter(F.col(column) >= F.lit(low))
    return rows.filter(F.col(column) < F.lit(high)) if high is not None else rows


def tables_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """information_schema.tables of a declared catalogue."""
    return spark.createDataFrame([(t.name, "VIEW" if t.view else "BASE TABLE") for t in catalog.tables.values()], "table_name string, table_type string")


def constraints_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """information_schema.table_constraints, with the columns of keys and references."""
    rows = []
    for t in catalog.tables.values():
        rows += [(t.name, k.name, "PRIMARY KEY" if k.primary else "UNIQUE", ",".join(k.columns), None) for k in t.keys]
        rows += [(t.name, f.name, "FOREIGN KEY", ",".join(f.columns), f.table) for f in t.foreign]
        rows += [(t.name, c.name, "CHECK", None, None) for c in t.checks]
    return spark.createDataFrame(rows, "table_name string, constraint_name string, constraint_type string, columns string, refers_to string")


def columns_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """information_schema.columns of a declared catalogue."""
    rows = [(t.name, c.name, i, c.type, c.nullable, c.default) for t in catalog.tables.values() for i, c in enumerate(t.columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean, column_default string")


def sample(df: DataFrame, percent: float, seed: int, system: bool = False) -> DataFrame:
    """TABLESAMPLE BERNOULLI or SYSTEM (whole blocks; here too row by row) REPEATABLE: rows are chosen by a hash of their values, so the choice doesn't depend on files or partitions; equal rows stay or go together."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(1_000_000))
    return df.filter(h < F.lit(percent * 10_000))
