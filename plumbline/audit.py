"""Constraint audits: the rows that break a declared constraint, as distributed jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.catalog import Table
from plumbline.operators import scans


def duplicates(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """(columns, n) of keys that occur more than once. Keys with a null never clash. Counts combine before the exchange, so a hot key is one row a task."""
    rows = df.filter(where) if where else df
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return rows.filter(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of child whose key is complete and not in parent."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    return child.filter(known).join(keys, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)], "left_anti")


def broken(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows for which a check is false; null passes."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~F.coalesce(p, F.lit(True)))


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def overlaps(df: DataFrame, keys: list[str], low: str, high: str, ties: Sequence[str] = ()) -> DataFrame:
    """Rows of half-open ranges that begin before an earlier one of their key has ended (WITHOUT OVERLAPS): one sorted scan, no pairs.

    Of ranges that begin together, the first by `ties` (the least upper bound without them) counts as the earlier one.
    """
    reached = scans.carried(df.filter(F.col(low) < F.col(high)), keys, [low, *(ties or [high])], high, "_reach")
    return reached.filter(F.col("_reach") > F.col(low)).drop("_reach")


def transitions(before: DataFrame, after: DataFrame, keys: list[str], column: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """(keys, old, new) of rows whose state moved otherwise than allowed; staying is no move."""
    old = before.select(*keys, F.col(column).alias("old"))
    new = after.select(*keys, F.col(column).alias("new"))
    moves = reduce(lambda a, b: a | b, ((F.col("old") == a) & (F.col("new") == b) for a, b in allowed), F.lit(False))
    return old.join(new, keys).filter(~F.col("old").eqNullSafe(F.col("new")) & ~F.coalesce(moves, F.lit(False)))


def history_transitions(df: DataFrame, keys: list[str], order: list[str], column: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """The same over each entity's history."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stepped = df.withColumn("old", F.lag(column).over(w)).withColumn("new", F.col(column))
    moves = reduce(lambda a, b: a | b, ((F.col("old") == a) & (F.col("new") == b) for a, b in allowed), F.lit(False))
    return stepped.filter(F.col("old").isNotNull() & (F.col("old") != F.col("new")) & ~moves)


def narrowing(df: DataFrame, column: str, to: str) -> DataFrame:
    """Rows whose value doesn't survive a cast there and back."""
    back = F.col(column).try_cast(to).cast(df.schema[column].dataType)
    return df.filter(F.col(column).isNotNull() & ~back.eqNullSafe(F.col(column)))


def store_errors(table: Table, df: DataFrame) -> DataFrame:
    """(column_name, reason, n) of values that a strict store into the declared table would refuse: out of range, too long, no label, null. One pass."""
    tests = []
    for c in table.columns:
        if c.name not in df.columns:
            continue
        v, known = F.col(f"`{c.name}`"), F.col(f"`{c.name}`").isNotNull()
        if not c.nullable:
            tests.append((c.name, "null", ~known))
        if c.labels:
            tests.append((c.name, "no label", known & ~v.isin(*c.labels)))
        elif c.length:
            tests.append((c.name, "too long", known & (F.char_length(F.rtrim(v.cast("string"))) > c.length)))
        elif df.schema[c.name].dataType.simpleString() != c.type:
            tests.append((c.name, "out of range", known & v.try_cast(c.type).isNull()))
    counts = df.agg(*[F.count_if(t).alias(f"c{i}") for i, (_, _, t) in enumerate(tests)])
    told = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(r).alias("reason"), F.col(f"c{i}").alias("n")) for i, (n, r, _) in enumerate(tests)])
    return counts.select(F.explode(told).alias("r")).select("r.*").filter("n > 0")


def report(table: Table, df: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """(constraint_name, kind, violations) for every declared constraint: row-wise ones in a single pass, keys and references one job each."""
    spark = df.sparkSession
    rowwise = [(f"{table.name}_{c.name}_not_null", "not null", F.count_if(F.col(c.name).isNull())) for c in table.columns if not c.nullable]
    rowwise += [(c.name, "check", F.count_if(~F.coalesce(F.expr(c.predicate), F.lit(True)))) for c in table.checks]
    out = []
    if rowwise:
        counts = df.agg(*[e.alias(f"c{i}") for i, (_, _, e) in enumerate(rowwise)])
        told = F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("violations")) for i, (n, k, _) in enumerate(rowwise)])
        out.append(counts.select(F.explode(told).alias("r")).select("r.*"))
    for k in table.keys:
        out.append(duplicates(df, list(k.columns), k.where).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k.name).alias("constraint_name"), F.lit("unique").alias("kind"), "violations"))
    for f in table.foreign:
        if f.table in parents:
            bad = orphans(df, list(f.columns), parents[f.table], list(f.parent)).agg(F.count(F.lit(1)).alias("violations"))
            out.append(bad.select(F.lit(f.name).alias("constraint_name"), F.lit("foreign key").alias("kind"), "violations"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "constraint_name string, kind string, violations long")
