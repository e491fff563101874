"""SQL/JSON over JSON strings: JSON_VALUE, JSON_QUERY, JSON_EXISTS, JSON_TABLE, constructors, containment."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import json_udf


def _scalar(v: Column, path: str, returning: str, on_empty: object, on_error: object) -> Column:
    """JSON_VALUE at a path of a variant: on_empty where the path is missing, null for JSON's null, on_error for an object, an array or what can't be cast."""
    found = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(found)
    value = F.try_variant_get(found, "$", returning)
    failed = kind.startswith("OBJECT") | kind.startswith("ARRAY") | ((kind != "VOID") & value.isNull())
    return F.when(found.isNull(), F.lit(on_empty).cast(returning)).when(failed, F.lit(on_error).cast(returning)).otherwise(value)


def json_value(doc: Column, path: str, returning: str = "string", on_empty: object = None, on_error: object = None) -> Column:
    """The scalar at a path, cast leniently; on_empty where the path is missing, on_error where the value isn't of the type or the text isn't JSON. JSON's null is null."""
    parsed = F.try_parse_json(doc)
    missing = F.lit(None).cast(returning)
    return F.when(doc.isNull(), missing).when(parsed.isNull(), F.lit(on_error).cast(returning)).otherwise(_scalar(parsed, path, returning, on_empty, on_error))


def json_query(doc: Column, path: str, wrapper: bool = False) -> Column:
    """The object or array at a path as JSON text; with `wrapper`, scalars come as an array of one."""
    found = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    kind = F.schema_of_variant(found)
    composite = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(composite, F.get_json_object(doc, path)).when(F.lit(wrapper) & found.isNotNull(), F.concat(F.lit("["), F.to_json(found), F.lit("]")))


def json_exists(doc: Column, path: str) -> Column:
    return F.when(doc.isNotNull(), F.try_variant_get(F.try_parse_json(doc), path, "variant").isNotNull())


def is_json(doc: Column, kind: str = "value") -> Column:
    """IS JSON [OBJECT | ARRAY | SCALAR]."""
    ok = F.try_parse_json(doc).isNotNull()
    head = F.substring(F.ltrim(doc), 1, 1)
    test = {"value": F.lit(True), "object": head == "{", "array": head == "[", "scalar": ~head.isin("{", "[")}[kind]
    return F.when(doc.isNotNull(), ok & test)


def json_object(pairs: dict[str, Column], absent_on_null: bool = False) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in pairs.items()]), {"ignoreNullFields": str(absent_on_null).lower()})


def json_array(values: list[Column], absent_on_null: bool = False) -> Column:
    """Values of one type."""
    array = F.array(*values)
    return F.to_json(F.filter(array, lambda x: x.isNotNull()) if absent_on_null else array)


class DuplicateKey(ValueError):
    pass


def json_object_unique(pairs: list[tuple[str, Column]], absent_on_null: bool = False) -> Column:
    """JSON_OBJECT(... WITH UNIQUE KEYS): keys are constants, so doubles raise DuplicateKey before anything runs."""
    keys = [k for k, _ in pairs]
    if double := sorted({k for k in keys if keys.count(k) > 1}):
        raise DuplicateKey(", ".join(double))
    return json_object(dict(pairs), absent_on_null)


def json_scalar(x: Column) -> Column:
    """JSON_SCALAR: a number or truth value as it is, anything else as a JSON string; null for null."""
    return F.when(x.isNotNull(), F.to_json(F.to_variant_object(F.array(x))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(x)))) - 2))


def json_serialize(doc: Column) -> Column:
    """JSON_SERIALIZE: the document's text without insignificant blanks; null for null, an error for what isn't JSON."""
    return F.to_json(F.parse_json(doc))


def json_array_subquery(df: DataFrame, value: Column, *order: Column) -> DataFrame:
    """JSON_ARRAY(SELECT value ... ORDER BY order): one row, an array of all non-null values, [] without rows."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)] or [value.alias("k0")]
    sorted_values = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*keys, value.alias("v"))))), lambda s: s["v"])
    return df.agg(F.to_json(sorted_values).alias("value"))


@dataclass(frozen=True)
class Path:
    """A JSON_TABLE column: name, type and path below the row; exists: whether the path is there; default ON EMPTY, on_error ON ERROR."""

    name: str
    type: str
    path: str
    exists: bool = False
    default: object = None
    on_error: object = None


@dataclass(frozen=True)
class Nested:
    """NESTED PATH: rows of an array below the row, outer-joined to it; with paths nested in it."""

    array: str
    columns: list[Path] = field(default_factory=list)
    ordinality: str | None = None
    nested: list[Nested] = field(default_factory=list)


def _elements(v: Column, path: str) -> Column:
    """The elements of the array at a path of a variant."""
    return F.try_variant_get(v, path, "array<variant>")


def _taken(v: Column, c: Path) -> Column:
    if c.exists:
        return F.when(v.isNotNull(), F.try_variant_get(v, c.path, "variant").isNotNull()).alias(c.name)
    return F.when(v.isNotNull(), _scalar(v, c.path, c.type, c.default, c.on_error)).alias(c.name)


def _numbered(k: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(k).alias("which"), (i + 1).cast("long").alias("at"), x.alias("item"))


def _nest(df: DataFrame, source: str, nested: list[Nested], depth: int) -> DataFrame:
    """df with the columns of the paths nested in the variant `source`. Siblings don't multiply: each has rows of its own."""
    if not nested:
        return df.drop(source)
    item, which = f"_item{depth}", f"_which{depth}"
    kind = "array<struct<which:int,at:bigint,item:variant>>"
    rows = [F.coalesce(F.transform(_elements(F.col(source), n.array), _numbered(k)), F.array().cast(kind)) for k, n in enumerate(nested)]
    out = df.select(*[c for c in df.columns if c != source], F.explode_outer(F.concat(*rows)).alias(which))
    for k, n in enumerate(nested):
        own = F.coalesce(F.col(f"{which}.which") == k, F.lit(False))
        value = F.when(own, F.col(f"{which}.item"))
        number = [F.when(own, F.col(f"{which}.at")).alias(n.ordinality)] if n.ordinality else []
        out = out.select("*", *number, value.alias(f"{item}_{k}"))
        out = out.select("*", *[_taken(F.col(f"{item}_{k}"), c) for c in n.columns])
    out = out.drop(which)
    for k, n in enumerate(nested):
        out = _nest(out, f"{item}_{k}", n.nested, depth + 1 + k * 8)
    return out


def json_table(df: DataFrame, doc: Column, rows: str, columns: list[Path], ordinality: str | None = None, nested: Nested | list[Nested] | None = None) -> DataFrame:
    """df joined laterally with the rows of the array at `rows`. The document is parsed once."""
    out = df.select("*", F.posexplode(_elements(F.try_parse_json(doc), rows)).alias("_i", "_row"))
    out = out.select(*df.columns, "_row", *([(F.col("_i") + 1).cast("long").alias(ordinality)] if ordinality else []), *[_taken(F.col("_row"), c) for c in columns])
    return _nest(out, "_row", [nested] if isinstance(nested, Nested) else nested or [], 0)


def contains(a: Column, b: Column) -> Column:
    """jsonb's a @> b, at every depth."""
    return json_udf.json_contains(a, b)


def extract_path(doc: Column, *steps: str | int) -> Column:
    """json #> path as JSON text; keys and indexes from 0."""
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), path, "variant"))


def extract_path_text(doc: Column, *steps: str | int) -> Column:
    """json #>> path: strings without quotes, JSON's null as null, the rest as JSON text."""
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    found = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind == "STRING", F.try_variant_get(found, "$", "string")).when(kind != "VOID", F.to_json(found))


def has_key(doc: Column, key: str) -> Column:
    """jsonb ? key: a top-level key, or a string element of a top-level array."""
    v = F.try_parse_json(doc)
    kind = F.schema_of_variant(v)
    strings = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    held = F.exists(strings, lambda x: F.try_variant_get(x, "$", "string") == key)
    return F.when(v.isNotNull(), F.when(kind.startswith("OBJECT"), F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))).when(kind.startswith("ARRAY"), held).otherwise(F.lit(False)))


def has_any_key(doc: Column, keys: list[str]) -> Column:
    """jsonb ?| keys."""
    return reduce(lambda a, b: a | b, (has_key(doc, k) for k in keys))


def has_all_keys(doc: Column, keys: list[str]) -> Column:
    """jsonb ?& keys."""
    return reduce(lambda a, b: a & b, (has_key(doc, k) for k in keys))


def delete_path(doc: Column, path: str) -> Column:
    """jsonb #- path (a path of the form $.a[0])."""
    return json_udf.json_remove(doc, path)


def to_record(doc: Column, fields: dict[str, str]) -> Column:
    """jsonb_to_record(doc) AS (fields): a struct of the named members, cast; what is missing or can't be cast is null."""
    v = F.try_parse_json(doc)
    return F.struct(*[F.try_variant_get(v, f"$['{name}']", kind).alias(name) for name, kind in fields.items()])


def to_recordset(df: DataFrame, doc: Column, fields: dict[str, str]) -> DataFrame:
    """df joined laterally with jsonb_to_recordset(doc) AS t(fields): a row for each element of the array, members cast; what is missing is null."""
    elements = F.try_variant_get(F.try_parse_json(doc), "$", "array<variant>")
    out = df.select("*", F.explode(elements).alias("_element"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.try_variant_get("_element", f"$['{n}']", t).alias(n) for n, t in fields.items()])


def each_text(df: DataFrame, doc: Column) -> DataFrame:
    """json_each_text: (df.*, key, value)."""
    return df.select("*", F.explode(F.from_json(doc, "map<string,string>")))
