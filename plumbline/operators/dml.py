"""Writes as DataFrames: each returns the table after the write and the rows that RETURNING would give.

A write doesn't change files. `commit` writes the new state beside the old one and swaps a pointer, so that readers see one or
the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import catalog


class WriteConflict(ValueError):
    """Several source rows for one target row."""


@dataclass(frozen=True)
class Write:
    """table: the state after the write; returning: affected rows, `_action` with them, old values as old_<column> where there are any."""

    table: DataFrame
    returning: DataFrame


def _null(df: DataFrame, c: str) -> Column:
    return F.lit(None).cast(df.schema[c].dataType)


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None, identity: str | None = None) -> Write:
    """INSERT: columns that rows lacks take their default or null; `identity` continues from the table's maximum."""
    filled = rows
    for c in target.columns:
        if c not in rows.columns and c != identity:
            filled = filled.withColumn(c, (defaults or {}).get(c, _null(target, c)).cast(target.schema[c].dataType))
    if identity and identity not in rows.columns:
        top = target.agg(F.coalesce(F.max(identity), F.lit(0)).alias("_top"))
        # unique and increasing without a task that sees all rows; like a sequence's, the numbers may have gaps
        filled = filled.withColumn("_n", F.monotonically_increasing_id()).crossJoin(F.broadcast(top)).withColumn(identity, (F.col("_top") + 1 + F.col("_n")).cast(target.schema[identity].dataType)).drop("_n", "_top")
    new = filled.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return Write(target.unionByName(new), new.withColumn("_action", F.lit("INSERT")))


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def check_single(rows: DataFrame, keys: Sequence[str]) -> None:
    """Raises WriteConflict if a key occurs twice: a target row may be changed once. Keys with a null never clash."""
    if rows.filter(_complete(keys)).groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise WriteConflict(f"several rows for one {', '.join(keys)}")


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, where: Column | None = None) -> Write:
    """INSERT ... ON CONFLICT (keys) DO UPDATE SET update [WHERE where], or DO NOTHING without update.

    Expressions name the row in the table by its columns and the proposed one as excluded_<column>. Null keys never conflict.
    Of several proposed rows with one key, DO NOTHING inserts the least by its columns; DO UPDATE raises WriteConflict.
    """
    if update:
        check_single(rows, keys)
        return _upserted(target, rows, keys, update, where)
    return _upserted(target, _one_a_key(rows.select(*target.columns), keys, (), F.min_by), keys)


def _upserted(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, where: Column | None = None) -> Write:
    """rows, one a key, written over target."""
    names = target.columns
    proposed = rows.select(*[F.col(c).alias(f"excluded_{c}") for c in names], F.lit(True).alias("_new"))
    held = target.withColumn("_old", F.lit(True))
    on = [held[k] == proposed[f"excluded_{k}"] for k in keys]
    both = held.join(proposed, on, "full")
    hit, fresh = F.col("_old") & F.col("_new"), F.col("_old").isNull()
    change = hit & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)) if update else F.lit(False)
    change = F.coalesce(change, F.lit(False))
    after = [F.when(fresh, F.col(f"excluded_{c}")).when(change, (update or {}).get(c, F.col(c))).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) for c in names]
    action = F.when(fresh, "INSERT").when(change, "UPDATE")
    told = both.select(*after, action.alias("_action"), *[F.col(c).alias(f"old_{c}") for c in names])
    return Write(told.select(*names), told.filter(F.col("_action").isNotNull()))


def _one_a_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], pick: Callable[[Column, Column], Column]) -> DataFrame:
    """One row for each complete key, by F.min_by or F.max_by of order; rows whose key has a null stay. Tasks keep one row a key before the exchange."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    ranks = F.struct(*[F.struct(o.isNull(), o) for o in [*order, *[F.col(c) for c in rows.columns]]])
    best = rows.filter(_complete(keys)).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(whole, ranks).alias("_row")).select("_row.*")
    return best.unionByName(rows.filter(~_complete(keys)))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> Write:
    """INSERT IGNORE: rows whose key is held, or comes again after the first by `order`, are left out."""
    return _upserted(target, _one_a_key(rows, keys, order, F.min_by), keys)


def replace_into(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> Write:
    """REPLACE: the last proposed row of a key by `order` takes the place of the held one, whole. `_action` is INSERT or REPLACE."""
    names = target.columns
    last = _one_a_key(rows, keys, order, F.max_by)
    write = _upserted(target, last, keys, {c: F.col(f"excluded_{c}") for c in names})
    return Write(write.table, write.returning.withColumn("_action", F.when(F.col("_action") == "UPDATE", "REPLACE").otherwise(F.col("_action"))))


def on_duplicate_key(target: DataFrame, rows: DataFrame, keys: Sequence[str], assign: dict[str, Callable[[Column, Column], Column]], order: Sequence[Column]) -> Write:
    """INSERT ... ON DUPLICATE KEY UPDATE: the proposed rows of a key are applied one after the other, by `order`.

    assign: for each column, a function of the row as it stands and the proposed one, both structs of the table's columns.
    A key's proposed rows meet in one array: as many as are written to one row.
    """
    names = target.columns
    typed = lambda get: F.struct(*[get(c).cast(target.schema[c].dataType).alias(c) for c in names])
    proposed = rows.select(typed(F.col).alias("new"), F.struct(*[F.struct(o.isNull(), o) for o in [*order, *[F.col(c) for c in names]]]).alias("at"), _complete(keys).alias("known"))
    keyed = [F.col(f"new.{k}").alias(f"_k{i}") for i, k in enumerate(keys)]
    lists = proposed.filter("known").groupBy(*keyed).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("news"))
    held = target.select(typed(F.col).alias("old"))
    both = held.join(lists, [F.col(f"old.{k}") == F.col(f"_k{i}") for i, k in enumerate(keys)], "full")
    start = F.coalesce(F.col("old"), F.col("news")[0])
    rest = F.when(F.col("news").isNull(), F.slice("news", 1, 0)).when(F.col("old").isNull(), F.slice("news", F.lit(2), F.size("news"))).otherwise(F.col("news"))
    applied = F.aggregate(F.coalesce(rest, F.array().cast(lists.schema["news"].dataType)), start, lambda row, new: typed(lambda c: assign[c](row, new) if c in assign else row[c]))
    action = F.when(F.col("news").isNotNull(), F.when(F.col("old").isNull(), "INSERT").otherwise("UPDATE"))
    told = both.select(applied.alias("row"), action.alias("_action"), *[F.col(f"old.{c}").alias(f"old_{c}") for c in names])
    alone = proposed.filter("NOT known").select(F.col("new").alias("row"), F.lit("INSERT").alias("_action"), *[F.lit(None).cast(target.schema[c].dataType).alias(f"old_{c}") for c in names])
    told = told.unionByName(alone).select("row.*", "_action", *[f"old_{c}" for c in names])
    return Write(told.select(*names), told.filter(F.col("_action").isNotNull()))


def truncate(target: DataFrame) -> Write:
    """TRUNCATE: the table without rows. Nothing is read and nothing returned."""
    none = target.limit(0)
    return Write(none, none.withColumn("_action", F.lit("DELETE")))


def create_table_as(spark: SparkSession, rows: DataFrame, root: str, with_data: bool = True, if_not_exists: bool = False) -> DataFrame:
    """CREATE TABLE ... AS SELECT ... [WITH NO DATA]: a versioned table of the rows. One that exists raises WriteConflict, or stays with if_not_exists."""
    if committed(spark, root):
        if if_not_exists:
            return current(spark, root)
        raise WriteConflict(f"{root} exists")
    commit(spark, rows if with_data else rows.limit(0), root, 0)
    return current(spark, root)


def coerced(target: catalog.Table, rows: DataFrame) -> DataFrame:
    """rows as an assignment stores them: cast to the column's type, checked against enum labels, text longer than its column only if blanks are cut.

    A value that doesn't fit raises when the row is computed, as in the dialects' strict modes.
    """
    out = []
    for name in rows.columns:
        declared, value = target.column(name), F.col(f"`{name}`")
        stored = value.cast(declared.type)
        if declared.labels:
            stored = F.when(value.isNull() | value.isin(*declared.labels), stored).otherwise(F.raise_error(F.concat(F.lit(f"no label of {name}: "), value)).cast(declared.type))
        if declared.length:
            cut = F.substring(stored, 1, declared.length)
            fits = (F.char_length(stored) <= declared.length) | (F.rtrim(stored) == F.rtrim(cut))
            stored = F.when(stored.isNull() | fits, cut).otherwise(F.raise_error(F.lit(f"value too long for {name}({declared.length})")).cast(declared.type))
        out.append(stored.alias(name))
    return rows.select(*out)


def generated(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with GENERATED ALWAYS AS (expression) columns computed from the others; given values for them raise WriteConflict."""
    given = [c for c in columns if c in rows.columns]
    if given:
        raise WriteConflict(f"generated columns can't be written: {', '.join(given)}")
    return rows.withColumns(columns)


def update_row(target: DataFrame, columns: Sequence[str], source: DataFrame, values: Sequence[str], on: dict[str, str], where: Column | None = None) -> Write:
    """UPDATE ... SET (columns) = (SELECT values FROM source WHERE target.k = source.s for k, s of `on`) [WHERE where].

    Rows without a match are set to nulls, as an empty subquery gives; two matches raise WriteConflict.
    """
    check_single(source, list(on.values()))
    given = source.select(*[F.col(s).alias(f"_k{i}") for i, s in enumerate(on.values())], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    joined = target.join(given, [target[k] == F.col(f"_k{i}") for i, k in enumerate(on)], "left")
    write = update(joined, {c: F.col(f"_v{i}") for i, c in enumerate(columns)}, where)
    return Write(write.table.select(*target.columns), write.returning.select(*target.columns, *[f"old_{c}" for c in target.columns], "_action"))


def update(target: DataFrame, assign: dict[str, Column], where: Column | None = None) -> Write:
    """UPDATE ... SET ... WHERE: one pass over the table."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    marked = target.withColumn("_hit", hit)
    new = [F.when(F.col("_hit"), assign[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in target.columns]
    told = marked.select(*new, *[F.col(c).alias(f"old_{c}") for c in target.columns], "_hit")
    return Write(told.select(*target.columns), told.filter("_hit").drop("_hit").withColumn("_action", F.lit("UPDATE")))


def update_from(target: DataFrame, source: DataFrame, on: Column, keys: Sequence[str], assign: dict[str, Column], single: bool = True) -> Write:
    """UPDATE ... FROM source WHERE on. `keys` name the columns of source that identify its rows for the check of one match a row; names of the two must differ."""
    if single:
        check_single(source, keys)
    joined = target.join(source.withColumn("_hit", F.lit(True)), on, "left")
    hit = F.col("_hit").isNotNull()
    new = [F.when(hit, assign[c].cast(target.schema[c].dataType)).otherwise(target[c]).alias(c) if c in assign else target[c] for c in target.columns]
    told = joined.select(*new, *[target[c].alias(f"old_{c}") for c in target.columns], hit.alias("_hit"))
    return Write(told.select(*target.columns), told.filter("_hit").drop("_hit").withColumn("_action", F.lit("UPDATE")))


def delete(target: DataFrame, where: Column) -> Write:
    hit = F.coalesce(where, F.lit(False))
    return Write(target.filter(~hit), target.filter(hit).withColumn("_action", F.lit("DELETE")))


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> Write:
    """DELETE ... USING source WHERE on: semi and anti join, so a row with many matches goes once."""
    return Write(target.join(source, on, "left_anti"), target.join(source, on, "left_semi").withColumn("_action", F.lit("DELETE")))


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    matched_update: dict[str, Column] | None = None,
    matched_delete: Column | None = None,
    insert_missing: bool = True,
    not_matched_by_source: str | None = None,
    matched_where: Column | None = None,
    single: bool = True,
) -> Write:
    """MERGE on equal keys. Expressions name the target's columns and the source's as source_<column>.

    MATCHED rows are deleted where matched_delete holds, else updated (where matched_where holds); NOT MATCHED rows are
    inserted; NOT MATCHED BY SOURCE rows are deleted if not_matched_by_source is "delete".
    """
    if single:
        check_single(source, keys)
    names = target.columns
    given = source.select(*[F.col(c).alias(f"source_{c}") for c in source.columns], F.lit(True).alias("_s"))
    held = target.withColumn("_t", F.lit(True))
    both = held.join(given, [held[k] == given[f"source_{k}"] for k in keys], "full")
    matched, only_source, only_target = F.col("_t") & F.col("_s"), F.col("_t").isNull(), F.col("_s").isNull()
    gone = matched & F.coalesce(matched_delete, F.lit(False)) if matched_delete is not None else F.lit(False)
    changed = matched & (F.coalesce(matched_where, F.lit(False)) if matched_where is not None else F.lit(True)) if matched_update else F.lit(False)
    action = F.when(F.coalesce(gone, F.lit(False)), "DELETE").when(F.coalesce(changed, F.lit(False)), "UPDATE").when(only_source & F.lit(insert_missing), "INSERT")
    if not_matched_by_source == "delete":
        action = F.when(only_target, "DELETE").otherwise(action)
    told = both.withColumn("_action", action)
    value = lambda c: F.col(f"source_{c}") if c in source.columns else _null(target, c)
    new = [
        F.when(F.col("_action") == "INSERT", value(c)).when(F.col("_action") == "UPDATE", (matched_update or {}).get(c, F.col(c))).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
        for c in names
    ]
    told = told.select(*new, "_action", *[F.col(c).alias(f"old_{c}") for c in names], F.col("_t").alias("_held"))
    stays = (F.col("_held").isNotNull() & ~F.col("_action").eqNullSafe(F.lit("DELETE"))) | (F.col("_action") == "INSERT")
    return Write(told.filter(stays).select(*names), told.filter(F.col("_action").isNotNull()).drop("_held"))


def cascade_delete(deleted: DataFrame, key: str, children: list[tuple[DataFrame, str, str]]) -> list[Write]:
    """ON DELETE for each child (table, foreign key, action): CASCADE deletes, SET NULL clears the column, RESTRICT raises if a row refers to a deleted one."""
    out = []
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    for child, fk, action in children:
        if action == "CASCADE":
            out.append(delete_using(child, gone, child[fk] == gone["_gone"]))
        elif action == "SET NULL":
            out.append(update_from(child, gone, child[fk] == gone["_gone"], ["_gone"], {fk: _null(child, fk)}, single=False))
        elif child.join(gone, child[fk] == gone["_gone"], "left_semi").limit(1).count():
            raise WriteConflict(f"rows of {fk} refer to deleted ones")
    return out


def cascade_walk(tables: catalog.Catalog, frames: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, Write]:
    """What a DELETE of rows of a table does to all tables that refer to it, directly or through others, by the declared actions.

    Rows that RESTRICT (or no action) keeps from going raise WriteConflict. A table reached twice is changed twice; circles
    of CASCADE end where no more rows go.
    """
    out: dict[str, Write] = {}
    current = dict(frames)

    def walk(name: str, deleted: DataFrame, depth: int) -> None:
        for child, t in tables.tables.items():
            for f in t.foreign:
                if f.table != name or child not in current or depth > len(tables.tables):
                    continue
                keys = deleted.select(*[F.col(p).alias(f"_g{i}") for i, p in enumerate(f.parent)]).distinct()
                on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_g{i}") for i, c in enumerate(f.columns)))
                if f.on_delete == "CASCADE":
                    write = delete_using(current[child], keys, on)
                    current[child], out[child] = write.table, Write(write.table, out[child].returning.unionByName(write.returning) if child in out else write.returning)
                    walk(child, write.returning.drop("_action"), depth + 1)
                elif f.on_delete == "SET NULL":
                    write = update_from(current[child], keys, on, [f"_g{i}" for i in range(len(f.columns))], {c: _null(current[child], c) for c in f.columns}, single=False)
                    current[child], out[child] = write.table, write
                elif current[child].join(keys, on, "left_semi").limit(1).count():
                    raise WriteConflict(f"{f.name}: rows of {child} refer to deleted ones")

    walk(table, gone, 0)
    return out


def cascade_update(changed: DataFrame, old: str, new: str, children: list[tuple[DataFrame, str, str]]) -> list[Write]:
    """ON UPDATE of a key from `old` to `new` (columns of changed) for each child (table, foreign key, action): CASCADE follows, SET NULL clears, RESTRICT raises if a row refers to a changed key."""
    out = []
    moves = changed.filter(~F.col(old).eqNullSafe(F.col(new))).select(F.col(old).alias("_from"), F.col(new).alias("_to")).distinct()
    for child, fk, action in children:
        if action in ("CASCADE", "SET NULL"):
            value = F.col("_to") if action == "CASCADE" else _null(child, fk)
            out.append(update_from(child, moves, child[fk] == moves["_from"], ["_from"], {fk: value}))
        elif child.join(moves, child[fk] == moves["_from"], "left_semi").limit(1).count():
            raise WriteConflict(f"rows of {fk} refer to changed keys")
    return out


def committed(spark: SparkSession, root: str) -> int:
    """How many versions are committed below root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{root}/CURRENT").count() if found else 0


def commit(spark: SparkSession, table: DataFrame, root: str, version: int) -> str:
    """Writes a new state as root/v<version> and points root/CURRENT at it; readers use `current`. The old state stays for those who read it.

    A version that is committed stays as it is; what an attempt left that was cut short before that is written over.
    """
    path = f"{root}/v{version:08d}"
    if committed(spark, root) and spark.read.parquet(f"{root}/CURRENT").filter(F.col("version") == version).limit(1).count():
        return path
    table.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/CURRENT")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    top = spark.read.parquet(f"{root}/CURRENT").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v{top:08d}")
