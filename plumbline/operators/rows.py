"""Rows: DISTINCT ON, WITH TIES, functional-dependency grouping, lockstep unnest, ordinality, series, cross tabulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _cols(names: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def distinct_on(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order. An aggregate, not a window: tasks keep one row a key before the exchange, so a hot key doesn't gather.

    The order is ascending, nulls last, by columns that can be compared; negate numbers for a descending one.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    ranks = F.struct(*[F.struct(o.isNull(), o) for o in order])
    best = df.groupBy(*_cols(keys)).agg(F.min_by(row, ranks).alias("_row"))
    return best.select("_row.*")


def first_by_window(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON for orders that a struct can't express (descending strings, nulls last)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def limit_with_ties(df: DataFrame, n: int, order: Sequence[Column | _Order]) -> DataFrame:
    """The first n rows and those that tie with the n-th: a top-n finds the last key, a filter against that one row takes the ties."""
    if n <= 0:
        return df.limit(0)
    names = [f"_o{i}" for i in range(len(order))]
    parts = df.select("*", *[_plain(o).alias(a) for o, a in zip(order, names, strict=True)])
    ordering = [_direct(o, F.col(a)) for o, a in zip(order, names, strict=True)]
    top = parts.orderBy(*ordering).limit(n)
    ranked = top.select(*names, F.row_number().over(Window.orderBy(*ordering)).alias("_rn"))  # n rows
    last = ranked.orderBy(F.col("_rn").desc()).limit(1).select(*[F.col(a).alias(f"_l{a}") for a in names])
    low = parts.crossJoin(F.broadcast(last))
    return low.filter(_not_after(order, names)).drop(*names, *[f"_l{a}" for a in names])


def _plain(order: Column | _Order) -> Column:
    return _Order.of(order).expr


class _Order:
    """A sort order taken apart: asc/desc and the expression, from `Order` specs or plain columns."""

    def __init__(self, expr: Column, descending: bool) -> None:
        self.expr, self.descending = expr, descending

    @staticmethod
    def of(order: Column | _Order) -> _Order:
        return order if isinstance(order, _Order) else _Order(order, False)


def asc(c: Column | str) -> _Order:
    return _Order(F.col(c) if isinstance(c, str) else c, False)


def desc(c: Column | str) -> _Order:
    return _Order(F.col(c) if isinstance(c, str) else c, True)


def _direct(order: Column | _Order, c: Column) -> Column:
    return c.desc_nulls_last() if _Order.of(order).descending else c.asc_nulls_last()


def _not_after(order: Sequence[Column | _Order], names: list[str]) -> Column:
    out = F.lit(True)
    for o, a in reversed(list(zip(order, names, strict=True))):
        x, y = F.col(a), F.col(f"_l{a}")
        before = (x > y) if _Order.of(o).descending else (x < y)
        before = F.coalesce(before, x.isNotNull() & y.isNull())
        out = before | (x.eqNullSafe(y) & out)
    return out


class NotDependent(ValueError):
    pass


def check_dependent(table, keys: Sequence[str], dependent: Sequence[str]) -> None:
    """Raises NotDependent unless the grouped columns hold a key of the declared table, so that they determine its other columns."""
    held = any(k.where is None and set(k.columns) <= set(keys) and (k.primary or all(not table.column(c).nullable for c in k.columns)) for k in table.keys)
    if not held and set(dependent) - set(keys):
        raise NotDependent(f"{', '.join(sorted(set(dependent) - set(keys)))} must be grouped or aggregated: no key of {table.name} is")


def group_by_dependent(df: DataFrame, keys: Sequence[str], dependent: Sequence[str], *aggregates: Column) -> DataFrame:
    """GROUP BY keys with columns that the keys determine (a primary key's own columns): any value of the group is the value."""
    return df.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in dependent], *aggregates)


def unnest(df: DataFrame, arrays: dict[str, Column], ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """df with arrays unnested side by side, the shorter ones filled with nulls; `ordinality` numbers the elements from 1."""
    if len(arrays) > 1:
        longest = F.greatest(*[F.coalesce(F.size(a), F.lit(0)) for a in arrays.values()])
        steps = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
        out = df.withColumn("_i", F.explode_outer(steps) if outer else F.explode(steps))
        extra = [(F.col("_i") + 1).cast("long").alias(ordinality)] if ordinality else []
        return out.select("*", *[F.get(a, F.col("_i")).alias(n) for n, a in arrays.items()], *extra).drop("_i")
    ((name, array),) = arrays.items()
    gen = F.posexplode_outer(array) if outer else F.posexplode(array)
    out = df.select("*", gen.alias("_i", name))
    return (out.withColumn(ordinality, (F.col("_i") + 1).cast("long")) if ordinality else out).drop("_i")


def generate_series(start: Column, stop: Column, step: Column | None = None) -> Column:
    """The inclusive series as an array, empty where step leads away from stop (Spark's sequence would raise)."""
    step = F.lit(1) if step is None else step
    wrong = ((step > 0) & (start > stop)) | ((step < 0) & (start < stop))
    safe = F.sequence(start, F.when(wrong, start).otherwise(stop), step)
    return F.when(wrong, F.slice(safe, 1, 0)).otherwise(safe)


def crosstab(df: DataFrame, row: str, category: str, value: Column, categories: Sequence[str]) -> DataFrame:
    """One row a `row`, a column for each listed category: conditional sums in one aggregate, no pass to find the categories."""
    columns = [F.sum(F.when(F.col(category) == c, value)).alias(c) for c in categories]
    return df.groupBy(row).agg(*columns)
