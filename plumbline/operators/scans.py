"""Prefix scans: what the rows before a row of its key hold. A key with very many rows is cut by ranges of the order, and what each piece holds is carried on to the next."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.session import shared_dir

#: Rows of a key from which on it is cut.
HOT_ROWS = 1 << 22


def _last(c: str) -> Column:
    return F.last(c, ignorenulls=True)


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, how: str = "max", inclusive: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `name`: the greatest ("max") or last known ("last") value of the key's rows before each in the order, its own too if inclusive.

    Both ways give the same: keys of up to hot_rows rows are one window each; if there is a larger one, rows are dealt by
    ranges of key and order, and each range takes the result of those before it.
    """
    aggregate = F.max if how == "max" else _last
    end = 0 if inclusive else -1
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= hot_rows:
        return df.withColumn(name, aggregate(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)))
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/plumbline-scan-{uuid.uuid4().hex}"
    df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    table = spark.read.parquet(path)  # written: another run of the plan would deal the rows otherwise
    local = table.withColumn("_local", aggregate(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)))
    # a piece of a key gives one row here
    pieces = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = table.groupBy("_part", *keys).agg((F.max(value) if how == "max" else F.max_by(value, F.struct(*order))).alias("_all"))
    if how == "last":
        known = table.filter(F.col(value).isNotNull()).groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_all"))
        held = table.select("_part", *keys).distinct().alias("a").join(known.alias("b"), _same("a", "b", ["_part", *keys]), "left").select("a.*", "b._all")
    before = held.withColumn("_before", aggregate("_all").over(pieces)).drop("_all")
    joined = local.alias("a").join(before.alias("b"), _same("a", "b", ["_part", *keys]))
    merged = F.greatest("a._local", "b._before") if how == "max" else F.coalesce("a._local", "b._before")
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], merged.alias(name))


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in columns))


def as_of(left: DataFrame, right: DataFrame, on: dict[str, str], at: tuple[str, str], value: str, name: str, tie: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left with `name`: the value of the last row of right at or before each row's time, null if there is none.

    on: left's key columns and right's; at: the two time columns; of right's rows at one time the last by `tie` counts.
    The two sides are one sorted scan, not pairs. Rows of right without a value are passed over.
    """
    tie = tie or value
    keys = [f"_k{i}" for i in range(len(on))]
    ours = left.select(F.struct("*").alias("_row"), *[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(at[0]).alias("_at"), F.lit(1).alias("_side"))
    theirs = right.select(*[F.col(c).alias(k) for c, k in zip(on.values(), keys, strict=True)], F.col(at[1]).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_value"))
    theirs = theirs.filter(reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys)))  # null keys equal nothing
    both = ours.unionByName(theirs, allowMissingColumns=True)
    return carried(both, keys, ["_at", "_side", "_tie"], "_value", name, "last", True, hot_rows).filter("_side = 1").select("_row.*", name)
