"""Schema and row differences, and their application as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import Catalog, Table
from plumbline.operators import dml


@dataclass(frozen=True)
class Change:
    op: str  # add, drop, alter, rename
    kind: str  # table, column, key, foreign key, check
    name: str
    field: str | None = None
    before: str | None = None
    after: str | None = None


@dataclass(frozen=True)
class Intents:
    """What a diff can't know: renames (table.old -> new), drops that are meant, values for backfills, replacements of labels."""

    renames: dict[str, str] | None = None
    drops: frozenset[str] = frozenset()
    backfill: dict[str, str] | None = None
    relabel: dict[str, dict[str, str]] | None = None


class UnsafeMigration(ValueError):
    pass


def _properties(t: Table) -> dict[tuple[str, str], dict[str, str]]:
    out: dict[tuple[str, str], dict[str, str]] = {}
    for c in t.columns:
        out["column", f"{t.name}.{c.name}"] = {"type": c.type, "nullable": str(c.nullable), "default": str(c.default), "labels": ",".join(c.labels), "unit": str(c.unit)}
    for k in t.keys:
        out["key", f"{t.name}.{k.name}"] = {"columns": ",".join(k.columns), "primary": str(k.primary), "where": str(k.where)}
    for f in t.foreign:
        out["foreign key", f"{t.name}.{f.name}"] = {"columns": ",".join(f.columns), "parent": f"{f.table}({','.join(f.parent)})", "on delete": f.on_delete}
    for c in t.checks:
        out["check", f"{t.name}.{c.name}"] = {"predicate": c.predicate}
    return out


def compare(old: Catalog, new: Catalog, intents: Intents | None = None) -> list[Change]:
    """Changes from old to new, drops first, then renames, alterations and additions (parents before children)."""
    renames = (intents and intents.renames) or {}
    drops, renamed, alters, adds = [], [], [], []
    for name in old.tables:
        if name not in new.tables:
            drops.append(Change("drop", "table", name))
    for name in new.load_order():
        if name not in old.tables:
            adds.append(Change("add", "table", name))
            continue
        a, b = _properties(old[name]), _properties(new[name])
        for (kind, path), props in list(a.items()):
            if kind == "column" and path in renames:
                target = f"{name}.{renames[path]}"
                renamed.append(Change("rename", "column", path, None, path.partition(".")[2], renames[path]))
                a[kind, target] = a.pop((kind, path))
                del props
        drops += [Change("drop", kind, path) for kind, path in a if (kind, path) not in b]
        adds += [Change("add", kind, path) for kind, path in b if (kind, path) not in a]
        alters += [Change("alter", kind, path, f, a[kind, path][f], v) for (kind, path), props in b.items() if (kind, path) in a for f, v in props.items() if a[kind, path][f] != v]
    return drops + renamed + alters + adds


def alphabet() -> list[tuple[str, str, str]]:
    """(op, kind, field) of every change that `compare` can tell: what tests must cover."""
    kinds = {"table": (), "column": ("type", "nullable", "default", "labels", "unit"), "key": ("columns", "primary", "where"), "foreign key": ("columns", "parent", "on delete"), "check": ("predicate",)}
    out = [(op, kind, "") for kind in kinds for op in ("add", "drop")] + [("rename", "column", "")]
    return out + [("alter", kind, f) for kind, fields in kinds.items() for f in fields]


#: PostgreSQL's names of Spark's types.
_TYPES = {"string": "text", "double": "double precision", "float": "real", "binary": "bytea", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "variant": "jsonb", "int": "integer", "tinyint": "smallint"}


def _column_ddl(c) -> str:
    kind = f"varchar({c.length})" if c.length else _TYPES.get(c.type, c.type.replace("decimal", "numeric"))
    made = f" GENERATED ALWAYS AS ({c.generated}) STORED" if c.generated else " GENERATED BY DEFAULT AS IDENTITY" if c.identity else ""
    return f"{c.name} {kind}" + made + (f" DEFAULT {c.default}" if c.default else "") + ("" if c.nullable else " NOT NULL")


def _constraint_ddl(t: Table, kind: str, name: str) -> str:
    if kind == "key":
        k = next(k for k in t.keys if k.name == name)
        if k.where:
            return f"CREATE UNIQUE INDEX {k.name} ON {t.name} ({', '.join(k.columns)}) WHERE {k.where}"
        return f"ALTER TABLE {t.name} ADD CONSTRAINT {k.name} {'PRIMARY KEY' if k.primary else 'UNIQUE'} ({', '.join(k.columns)})"
    if kind == "foreign key":
        f = next(f for f in t.foreign if f.name == name)
        action = "" if f.on_delete == "RESTRICT" else f" ON DELETE {f.on_delete}"
        return f"ALTER TABLE {t.name} ADD CONSTRAINT {f.name} FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.table} ({', '.join(f.parent)}){action}"
    c = next(c for c in t.checks if c.name == name)
    return f"ALTER TABLE {t.name} ADD CONSTRAINT {c.name} CHECK ({c.predicate})"


def ddl(old: Catalog, new: Catalog, intents: Intents | None = None) -> list[str]:
    """The statements that lead from old to new, in an order that works: renames; references, checks and keys that go; columns and tables that go (children first); alterations; new tables (parents first) and columns; keys, checks, references."""
    changes = compare(old, new, intents)
    parts: dict[int, list[str]] = {}
    place = {n: i for i, n in enumerate(old.load_order())}
    for c in changes:
        table, _, name = c.name.partition(".")
        t = new.tables.get(table)
        if c.op == "rename":
            parts.setdefault(0, []).append(f"ALTER TABLE {table} RENAME COLUMN {c.before} TO {c.after}")
        elif c.op == "drop" and c.kind in ("foreign key", "check", "key"):
            parts.setdefault({"foreign key": 1, "check": 2, "key": 3}[c.kind], []).append(f"ALTER TABLE {table} DROP CONSTRAINT {name}")
        elif c.op == "drop" and c.kind == "column":
            parts.setdefault(4, []).append(f"ALTER TABLE {table} DROP COLUMN {name}")
        elif c.op == "drop":
            parts.setdefault(5, []).append(f"{len(place) - place[table]:06d} DROP TABLE {table}")
        elif c.op == "alter" and c.kind == "column":
            column = t.column(name)
            what = {
                "type": f"TYPE {_column_ddl(replace(column, default=None, nullable=True, identity=False, generated=None)).partition(' ')[2]}", "nullable": f"{'DROP' if column.nullable else 'SET'} NOT NULL",
                "default": f"SET DEFAULT {column.default}" if column.default else "DROP DEFAULT",
            }.get(c.field)
            if what:
                parts.setdefault(6, []).append(f"ALTER TABLE {table} ALTER COLUMN {name} {what}")
        elif c.op == "alter":
            gone = f"ALTER TABLE {table} DROP CONSTRAINT {name}"
            if gone not in parts.get(1, []):
                parts.setdefault(1, []).append(gone)
                parts.setdefault({"key": 9, "check": 10, "foreign key": 11}[c.kind], []).append(_constraint_ddl(t, c.kind, name))
        elif c.kind == "table":
            parts.setdefault(7, []).append(f"CREATE TABLE {table} ({', '.join(map(_column_ddl, t.columns))})" if not t.view else f"CREATE VIEW {table} AS {t.view}")
            for kind, step, items in (("key", 9, t.keys), ("check", 10, t.checks), ("foreign key", 11, t.foreign)):
                parts.setdefault(step, []).extend(_constraint_ddl(t, kind, x.name) for x in items)
        elif c.kind == "column":
            parts.setdefault(8, []).append(f"ALTER TABLE {table} ADD COLUMN {_column_ddl(t.column(name))}")
        else:
            parts.setdefault({"key": 9, "check": 10, "foreign key": 11}[c.kind], []).append(_constraint_ddl(t, c.kind, name))
    parts[5] = [x[7:] for x in sorted(parts.get(5, []))]
    return [s for k in sorted(parts) for s in parts[k]]


def changes_frame(spark: SparkSession, changes: list[Change]) -> DataFrame:
    return spark.createDataFrame([(c.op, c.kind, c.name, c.field, c.before, c.after) for c in changes], "op string, kind string, name string, field string, before string, after string")


def rewrite(df: DataFrame, old: Table, new: Table, intents: Intents | None = None) -> DataFrame:
    """The rows of old as rows of new, in one pass: renames, casts, relabelling, backfills and defaults. Drops must be meant."""
    intents = intents or Intents()
    renames = {k.partition(".")[2]: v for k, v in (intents.renames or {}).items() if k.partition(".")[0] == old.name}
    source = {renames.get(c.name, c.name): c.name for c in old.columns}
    for c in old.columns:
        if renames.get(c.name, c.name) not in {x.name for x in new.columns} and f"{old.name}.{c.name}" not in intents.drops:
            raise UnsafeMigration(f"{old.name}.{c.name} would be dropped")
    out = []
    for c in new.columns:
        path = f"{new.name}.{c.name}"
        value = F.col(source[c.name]) if c.name in source else F.expr(c.default) if c.default else F.lit(None)
        if c.name in source and c.labels:
            labels = (intents.relabel or {}).get(path, {})
            for a, b in labels.items():
                value = F.when(F.col(source[c.name]) == a, b).otherwise(value)
        if path in (intents.backfill or {}):
            value = F.coalesce(value, F.expr(intents.backfill[path]))
        out.append(value.cast(c.type).alias(c.name))
    return df.select(*out)


def row_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(op, keys, old, new structs) of rows added, dropped and changed, by key."""
    rest = [c for c in after.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("old"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.struct(*rest).alias("new"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    op = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "drop").when(~F.col("old").eqNullSafe(F.col("new")), "change")
    return both.withColumn("op", op).filter(F.col("op").isNotNull()).select("op", *keys, "old", "new")


def seed(target: DataFrame, rows: DataFrame, keys: list[str], prune: bool = False) -> dml.Write:
    """Declared rows merged into a table: missing ones inserted, different ones updated; others deleted if `prune`."""
    rest = [c for c in rows.columns if c not in keys]
    differ = None
    for c in rest:
        d = ~F.col(c).eqNullSafe(F.col(f"source_{c}"))
        differ = d if differ is None else differ | d
    return dml.merge(target, rows, keys, {c: F.col(f"source_{c}") for c in rest} or None, matched_where=differ, not_matched_by_source="delete" if prune else None)


def repartition(df: DataFrame, by: list[str], path: str) -> None:
    """A table rewritten in directories by column; rows of one directory are spread by size, so that a large one isn't one task."""
    df.hint("rebalance", *by).write.partitionBy(*by).mode("errorifexists").parquet(path)


def drift(declared: Catalog, actual: dict[str, DataFrame]) -> list[str]:
    """Where tables differ from their declaration in names or types."""
    out = [f"no table {n}" for n in declared.tables if n not in actual and not declared[n].view]
    for name, df in actual.items():
        if name not in declared.tables:
            out.append(f"undeclared table {name}")
            continue
        have, want = {f.name: f.dataType.simpleString() for f in df.schema}, {c.name: c.type for c in declared[name].columns}
        out += [f"{name}.{c}: missing" for c in want if c not in have] + [f"{name}.{c}: undeclared" for c in have if c not in want]
        out += [f"{name}.{c}: {have[c]}, declared {want[c]}" for c in want if c in have and have[c] != want[c]]
    return out


def consumers(changes: list[Change], statements: dict[str, str]) -> dict[str, list[str]]:
    """Statements whose text names a dropped or renamed column or table."""
    import re

    gone = {c.name.rpartition(".")[2] for c in changes if c.op in ("drop", "rename") and c.kind in ("column", "table")}
    return {n: hits for n, text in statements.items() if (hits := sorted(g for g in gone if re.search(rf"\b{re.escape(g)}\b", text)))}
