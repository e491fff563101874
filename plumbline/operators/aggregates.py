"""Aggregates: hypothetical-set ranks, ordered and null-keeping collections, JSON, MySQL's variants, range unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def hypothetical_rank(x: Column, v: Column) -> Column:
    """rank(x) WITHIN GROUP (ORDER BY v): one more than the values before x. Nulls sort last."""
    return (F.lit(1) + F.count_if(v < x)).cast("long")


def hypothetical_dense_rank(x: Column, v: Column) -> Column:
    return (F.lit(1) + F.count_distinct(F.when(v < x, v))).cast("long")


def hypothetical_percent_rank(x: Column, v: Column) -> Column:
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(v < x) / n)


def hypothetical_cume_dist(x: Column, v: Column) -> Column:
    return (F.count_if(v <= x) + F.lit(1)) / (F.count(F.lit(1)) + F.lit(1))


def array_agg(v: Column, *order: Column) -> Column:
    """All values, nulls too, in the order of `order` (the values' own without it)."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)] or [v.isNull().alias("k0"), v.alias("k1")]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, v.alias("v")))), lambda s: s["v"])


def string_agg(v: Column, separator: str, *order: Column) -> Column:
    """Non-null values joined in order."""
    ordered = F.filter(array_agg(v.cast("string"), *(order or (v,))), lambda x: x.isNotNull())
    return F.when(F.size(ordered) > 0, F.array_join(ordered, separator))


def json_agg(v: Column, *order: Column) -> Column:
    return F.to_json(array_agg(v, *order))


def json_object_agg(key: Column, value: Column) -> Column:
    """A JSON object with keys in their order."""
    pairs = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))
    return F.to_json(F.map_from_entries(pairs))


def bit_and(v: Column) -> Column:
    """MySQL's BIT_AND: all ones over no rows."""
    return F.coalesce(F.bit_and(v), F.lit(-1).cast("long"))


def bit_or(v: Column) -> Column:
    return F.coalesce(F.bit_or(v), F.lit(0).cast("long"))


def percentiles(v: Column, fractions: list[float]) -> Column:
    """percentile_cont(array) WITHIN GROUP (ORDER BY v)."""
    return F.array(*[F.percentile(v, f) for f in fractions])


def sum_in_order(df: DataFrame, keys: list[str], order: list[Column], v: Column, name: str) -> DataFrame:
    """sum(v) of each key, its values added one by one in `order`, as a column `name` beside the keys.

    A grouped sum of doubles adds up partial sums that depend on splits and on which task ends first, so that keys with the same values
    may differ in their last bits. One sorted pass a key; nothing is collected.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = df.select(*keys, F.sum(v).over(whole).alias(name), F.row_number().over(w).alias("_at"))
    return summed.filter(F.col("_at") == 1).drop("_at")


def range_union(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """range_agg: the ranges [low, high) of each key as disjoint ranges, by gaps and islands. One sorted pass a key."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col(low) > F.max(high).over(before), 1).when(F.max(high).over(before).isNull(), 1).otherwise(0)
    marked = df.filter(F.col(low) < F.col(high)).select(*keys, low, high, fresh.alias("_new"))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def range_intersection(low: Column, high: Column) -> tuple[Column, Column]:
    """range_intersect_agg of [low, high): its bounds; empty where low is not below high."""
    return F.max(low), F.min(high)
