"""Statements with typed rows and parameters: declared once, checked in every expansion, run lazily."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import re
import types
import typing
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline import template as templates

R = TypeVar("R")
P = TypeVar("P")


class NoRows(LookupError):
    pass


class ManyRows(LookupError):
    pass


class UnknownLabel(ValueError):
    pass


def snake(name: str) -> str:
    """customerID and CustomerId as customer_id."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


_FITS: dict[type, tuple[type, ...]] = {
    bool: (T.BooleanType,), int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), float: (T.FloatType, T.DoubleType), str: (T.StringType, T.CharType, T.VarcharType), bytes: (T.BinaryType,),
    decimal.Decimal: (T.DecimalType,), datetime.date: (T.DateType,), datetime.datetime: (T.TimestampType, T.TimestampNTZType), datetime.timedelta: (T.DayTimeIntervalType,), dict: (T.MapType, T.StructType), list: (T.ArrayType,),
}


def _optional(hint: Any) -> tuple[Any, bool]:
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        return (rest[0], True) if len(rest) == 1 else (hint, True)
    return hint, False


def fits(hint: Any, kind: T.DataType) -> bool:
    """Whether values of a Spark type can be read as the hinted Python type."""
    hint, _ = _optional(hint)
    if hint is Any:
        return True
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return isinstance(kind, T.StringType)
    if dataclasses.is_dataclass(hint):
        return isinstance(kind, T.StructType)
    origin = typing.get_origin(hint) or hint
    if origin is list and isinstance(kind, T.ArrayType):
        inner = typing.get_args(hint)
        return not inner or fits(inner[0], kind.elementType)
    return any(isinstance(kind, k) for k in _FITS.get(origin, ()))


def _flat(row: type) -> list[tuple[str, Any, tuple[str, ...]]]:
    """(column, hint, path) of a dataclass's fields; fields marked embedded are flattened."""
    hints, out = typing.get_type_hints(row), []
    for f in dataclasses.fields(row):
        if f.metadata.get("embedded"):
            out += [(c, h, (f.name, *p)) for c, h, p in _flat(hints[f.name])]
        else:
            out.append((f.metadata.get("column", snake(f.name)), hints[f.name], (f.name,)))
    return out


def check_shape(row: type, schema: T.StructType) -> list[str]:
    """What keeps a result from being read as `row`."""
    if not dataclasses.is_dataclass(row):
        return [] if len(schema) == 1 and fits(row, schema[0].dataType) else [f"{row} from {len(schema)} columns"]
    have, want = {f.name: f for f in schema}, {c: h for c, h, _ in _flat(row)}
    out = [f"no column {c}" for c in want if c not in have] + [f"no field for {c}" for c in have if c not in want]
    return out + [f"{c}: {have[c].dataType.simpleString()} as {h}" for c, h in want.items() if c in have and not fits(h, have[c].dataType)]


def _convert(hint: Any, value: Any) -> Any:
    hint, _ = _optional(hint)
    if value is None:
        return None
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        try:
            return hint(value)
        except ValueError:
            raise UnknownLabel(f"{value!r} is no {hint.__name__}") from None
    if dataclasses.is_dataclass(hint):
        return mapper(hint)(value)
    if typing.get_origin(hint) is list and typing.get_args(hint):
        return [_convert(typing.get_args(hint)[0], v) for v in value]
    return value


def mapper(row: type) -> Callable[[Any], Any]:
    """From a Spark Row (or struct) to `row`: by column name in snake case, embedded fields flattened, nested rows and lists converted."""
    if not dataclasses.is_dataclass(row):
        return lambda r: _convert(row, r[0])
    hints = typing.get_type_hints(row)

    def build(r: Any) -> Any:
        values = {}
        for f in dataclasses.fields(row):
            values[f.name] = mapper(hints[f.name])(r) if f.metadata.get("embedded") else _convert(hints[f.name], r[f.metadata.get("column", snake(f.name))])
        return row(**values)

    return build


@dataclass(frozen=True)
class Query(Generic[R, P]):
    """A statement. row: dataclass or scalar type; template: its text; tables: name -> DataFrame at run time."""

    row: type
    template: str
    single: bool = False

    def expansions(self) -> list[templates.Expansion]:
        return templates.expand(self.template)

    def frame(self, spark: SparkSession, tables: dict[str, DataFrame], params: Any = None) -> DataFrame:
        """The lazy result: rendered, guarded, bound."""
        rendered = templates.render(self.template, params if params is not None else {})
        templates.guard(self.template, rendered)
        return spark.sql(rendered.sql, rendered.args, **tables)

    def check(self, spark: SparkSession, tables: dict[str, DataFrame], sample: dict[str, Any] | None = None) -> list[str]:
        """Problems of any expansion, found by analysis alone: no job runs. Unbound parameters are typed by `sample` or null."""
        out = [f"hazard: {h}" for h in templates.hazards(self.template)]
        for e in self.expansions():
            args = {f"p{i}": (sample or {}).get(n.lstrip(".")) for i, n in enumerate(e.parameters, 1)}
            try:
                schema = spark.sql(e.sql, args, **tables).schema
            except Exception as x:
                state = getattr(x, "getSqlState", lambda: None)()
                out.append(f"{state or type(x).__name__}: {str(x).splitlines()[0]} [{', '.join(e.branch)}]")
            else:
                out += [f"{p} [{', '.join(e.branch)}]" for p in check_shape(self.row, schema)]
        return out


def verify(spark: SparkSession, tables: dict[str, DataFrame], statements: dict[str, Query], samples: dict[str, dict[str, Any]] | None = None) -> list[tuple[str, str]]:
    """(name, problem) of declared statements: each expansion is analyzed and then run over empty tables, so that what only execution tells comes out too."""
    empty = {n: df.limit(0) for n, df in tables.items()}
    out = []
    for name, q in statements.items():
        sample = (samples or {}).get(name)
        problems = q.check(spark, empty, sample)
        out += [(name, p) for p in problems]
        for e in q.expansions() if not problems else []:
            args = {f"p{i}": (sample or {}).get(n.lstrip(".")) for i, n in enumerate(e.parameters, 1)}
            try:
                spark.sql(e.sql, args, **empty).collect()
            except Exception as x:
                out.append((name, f"{type(x).__name__}: {str(x).splitlines()[0]}"))
    return out


def query(row: type, template: str) -> Query:
    return Query(row, template)


def one(row: type, template: str) -> Query:
    """A statement of one row at most."""
    return Query(row, template, True)


@dataclass(frozen=True)
class Session:
    """Runs statements over a set of tables."""

    spark: SparkSession
    tables: dict[str, DataFrame]

    def run(self, q: Query, params: Any = None) -> Iterator[Any]:
        """Rows one by one: one partition at a time comes to the driver."""
        build = mapper(q.row)
        return (build(r) for r in q.frame(self.spark, self.tables, params).toLocalIterator())

    def collect(self, q: Query, params: Any = None) -> list[Any]:
        build = mapper(q.row)
        return [build(r) for r in q.frame(self.spark, self.tables, params).collect()]

    def first(self, q: Query, params: Any = None) -> Any | None:
        rows = q.frame(self.spark, self.tables, params).limit(1).collect()
        return mapper(q.row)(rows[0]) if rows else None

    def find(self, q: Query, params: Any = None) -> Any | None:
        """The one row or None; ManyRows for two."""
        rows = q.frame(self.spark, self.tables, params).limit(2).collect()
        if len(rows) > 1:
            raise ManyRows(q.template)
        return mapper(q.row)(rows[0]) if rows else None

    def get(self, q: Query, params: Any = None) -> Any:
        """The one row; NoRows without it."""
        found = self.find(q, params)
        if found is None:
            raise NoRows(q.template)
        return found

    def batch(self, queue: Iterable[tuple[Query, Any]]) -> list[list[Any]]:
        """All statements are rendered and analyzed before the first runs; the first error ends the batch."""
        frames = [(q, q.frame(self.spark, self.tables, p)) for q, p in queue]
        out = []
        for q, df in frames:
            rows = df.limit(2).collect() if q.single else df.collect()
            if q.single and len(rows) > 1:
                raise ManyRows(q.template)
            out.append([mapper(q.row)(r) for r in rows])
        return out


def dataclass_source(name: str, schema: T.StructType) -> str:
    """Source text of a dataclass that reads a result."""
    names = {T.BooleanType: "bool", T.BinaryType: "bytes", T.DateType: "datetime.date", T.TimestampType: "datetime.datetime", T.TimestampNTZType: "datetime.datetime", T.DecimalType: "decimal.Decimal", T.FloatType: "float", T.DoubleType: "float", T.StringType: "str"}

    def hint(kind: T.DataType) -> str:
        if isinstance(kind, T.ArrayType):
            return f"list[{hint(kind.elementType)}]"
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "int"
        return next((v for k, v in names.items() if isinstance(kind, k)), "dict")

    lines = [f"    {f.name}: {hint(f.dataType)}{' | None' if f.nullable else ''}" for f in schema]
    return "@dataclass\nclass " + name + ":\n" + "\n".join(lines or ["    pass"]) + "\n"
