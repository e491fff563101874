"""User-defined functions, aggregates and operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def create_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str, table: bool = False) -> None:
    """CREATE FUNCTION in SQL: scalar, or RETURNS TABLE. Its body is inlined by Catalyst."""
    kind = f"TABLE ({returns})" if table else returns
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def call_procedure(spark: SparkSession, body: str, inout: dict[str, tuple[str, object]]) -> dict[str, object]:
    """CALL of a procedure with INOUT arguments: body is a SQL script that may set them; their values afterwards.

    inout: name -> (type, value going in). Values are bound as literals of their type.
    """
    declared = "".join(f"DECLARE {n} {t} DEFAULT {'NULL' if v is None else _literal(v)};\n" for n, (t, v) in inout.items())
    row = spark.sql(f"BEGIN\n{declared}{body}\nSELECT {', '.join(inout)};\nEND").first()
    return row.asDict()


def _literal(v: object) -> str:
    if isinstance(v, bool) or not isinstance(v, str):
        return str(v)
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strict(f: Callable[..., Column]) -> Callable[..., Column]:
    """A function that is null for any null argument."""

    def call(*args: Column) -> Column:
        known = F.lit(True)
        for a in args:
            known = known & a.isNotNull()
        return F.when(known, f(*args))

    return call


def fold(values: Column, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """CREATE AGGREGATE (sfunc, stype, finalfunc) over an array of a group's values: for aggregates whose groups fit a task. Prefer sums and counts, which combine before the exchange."""
    return F.aggregate(values, start, step, finish) if finish else F.aggregate(values, start, step)


class Operators:
    """CREATE OPERATOR and CREATE CAST: symbols and pairs of types with functions of Columns, so that uses are rewritten into built-in expressions."""

    def __init__(self) -> None:
        self.operators: dict[str, Callable[..., Column]] = {}
        self.casts: dict[tuple[str, str], Callable[[Column], Column]] = {}

    def create_operator(self, symbol: str, f: Callable[..., Column], negator: str | None = None, commutator: str | None = None) -> None:
        self.operators[symbol] = f
        if negator:
            self.operators[negator] = lambda *a: ~f(*a)
        if commutator:
            self.operators[commutator] = lambda a, b: f(b, a)

    def create_cast(self, source: str, target: str, f: Callable[[Column], Column]) -> None:
        self.casts[source, target] = f

    def apply(self, symbol: str, *args: Column) -> Column:
        return self.operators[symbol](*args)

    def cast(self, x: Column, source: str, target: str) -> Column:
        """By a created cast, else the built-in one."""
        return self.casts.get((source, target), lambda c: c.cast(target))(x)


def call(name: str, x: Column, functions: dict[str, Callable[..., Column]], fields: tuple[str, ...] = ()) -> Column:
    """name(x) as SQL reads it: a function, else a field of a row, else a cast to a type."""
    if name in functions:
        return functions[name](x)
    return x.getField(name) if name in fields else x.cast(name)


def variadic(f: Callable[[Column], Column]) -> Callable[..., Column]:
    """A VARIADIC function of an array as one of any number of arguments; a single array passes as it is with `array`."""

    def call(*args: Column, array: Column | None = None) -> Column:
        return f(array if array is not None else F.array(*args))

    return call


def pandas_aggregate(f: Callable[[pd.Series], float], returns: str = "double") -> Callable[[Column], Column]:
    """An aggregate, also usable over windows, whose values come to Python by Arrow."""

    def run(v: pd.Series) -> float:
        return f(v)

    return F.pandas_udf(run, returns)
