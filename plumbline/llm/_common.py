"""Shared plumbing of the training-data operators: the shared folder, written tables, positions."""

from __future__ import annotations

import atexit
import contextlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.session import shared_dir

#: Words of every contract: runs of anything but the six ASCII white-space bytes. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}


#: Rows that go to a Python worker at a time: whole texts, so fewer than the session's 10,000.
BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, not made yet. Removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors. Removed when the driver's Python ends."""
    spark = df.sparkSession
    path = folder(spark, label)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def _delete(path: str) -> None:
    spark = _written.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no plan reads any more."""
    for t in tables:
        if t.written_path in _written:
            _delete(t.written_path)


def release() -> None:
    """Deletes all tables that written() made; only for the end of a program, or between independent runs."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended; a shared folder has its own clean-up
            return


atexit.register(release)


#: A key with at least this share of all rows is hot; there are at most as many as its inverse.
HOT_SHARE = 2.0**-15
HOT_ROWS = 64


def join_keys(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed (key, n, ...), one row a key; n: how many of the `total` rows have it.

    Hot keys, of which there can be few only, are joined by a broadcast; their rows go on spread out, so that no key draws
    its rows into one task.
    """
    limit = max(HOT_ROWS, math.ceil(total * HOT_SHARE))
    rest = [c for c in keyed.columns if c != key]
    hot = keyed.filter(F.col("n") >= limit).select(key, *[F.col(c).alias(f"_hot_{c}") for c in rest])
    cold = keyed.filter(F.col("n") < limit).select(F.col(key).alias("_key"), F.lit(False).alias("_is_hot"), *[F.col(c).alias(f"_cold_{c}") for c in rest])
    kind = rows.schema[key].dataType
    spread = F.xxhash64(*rows.columns).cast("string").cast(kind) if kind.typeName() == "binary" else F.xxhash64(*rows.columns).cast(kind)
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_is_hot", F.col("_hot_n").isNotNull())
    marked = marked.withColumn("_key", F.when(F.col("_is_hot"), spread).otherwise(F.col(key)))
    both = marked.join(cold, ["_key", "_is_hot"], "left")
    out = both.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in rest])
    return out.filter(F.col("n").isNotNull())


def with_positions(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """df with `name`: 0, 1, 2 ... in the order of keys, without a task that sees all rows.

    Range exchange, sort, written table; each partition's offset comes from the row counts of the partitions before it
    (one row a partition). Rows that tie in all keys get any order among themselves: give keys that make them alike.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie")).drop("_tie")
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    table = written(ranged, "positions")
    counts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return table.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_seq")).drop("_part", "_seq", "_before")


def distinct_documents(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """docs as (uid long, doc_id long, text string), and whether uid is doc_id itself. Columns in `carry` follow as _c0, _c1 ...

    Ids that are unique and never null serve as uid. Otherwise uids number the different (doc_id, text) pairs by
    ascending doc_id, null last, then by the text's SHA-256: rows alike in both columns are one document, and other
    documents under one id come in the order of that hash.
    """
    extra = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    held = [f"_c{i}" for i in range(len(carry))]
    odd = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.limit(1).count() == 0:
        return base.select(F.col("doc_id").alias("uid"), "doc_id", "text", *held), True
    keys = base.select("doc_id", F.sha2("text", 256).alias("sha")).distinct()
    numbered = with_positions(keys, [F.col("doc_id").asc_nulls_last(), F.col("sha")], "uid")
    keyed = base.withColumn("sha", F.sha2("text", 256)).alias("b").join(
        numbered.alias("k"), (F.col("b.doc_id").eqNullSafe(F.col("k.doc_id"))) & (F.col("b.sha") == F.col("k.sha"))
    )
    return keyed.select("uid", F.col("b.doc_id").alias("doc_id"), "text", *held), False
