"""Tumbling, sliding and session windows over events; the same functions take batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, size: str, by: list[str], slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, by, n, total) for each window; on a stream, rows later than `late` behind the newest are left out."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events no more than `gap` apart."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def read(spark: SparkSession, directory: str, like: DataFrame, files_a_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a directory."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(directory)


def upsert_stream(stream: DataFrame, root: str, keys: list[str], checkpoint: str, order: list[str]) -> StreamingQuery:
    """A stream merged into a versioned table: of a batch's rows with one key, the last by `order` is taken (ties by all columns).

    Each batch is one commit, numbered by the batch, so a batch that is run again changes nothing.
    """
    from plumbline.operators import dml

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = [F.col(c) for c in order]
        if dml.committed(spark, root):
            held = dml.current(spark, root)
        else:
            held = batch.limit(0)
        dml.commit(spark, dml.replace_into(held, batch, keys, at).table, root, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
