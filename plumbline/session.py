"""Sessions and tables: what every query needs before it begins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Settings that queries rely on; all can be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def builder(app: str = "plumbline", master: str | None = None) -> SparkSession.Builder:
    """A session builder with SETTINGS; cluster sizes (partitions, memory) are left to the cluster."""
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        b = b.master(master or os.environ["SPARK_MASTER"])
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


class SettingsError(RuntimeError):
    pass


def differences(spark: SparkSession, wanted: dict[str, str] | None = None) -> list[tuple[str, str, str | None]]:
    """(setting, wanted, actual) of settings that a running session has otherwise than statements were checked with."""
    return [(k, v, actual) for k, v in (wanted or SETTINGS).items() if (actual := spark.conf.get(k, None)) != v]


def verify_settings(spark: SparkSession, wanted: dict[str, str] | None = None) -> None:
    """Raises SettingsError at start-up if the session differs."""
    if found := differences(spark, wanted):
        raise SettingsError("; ".join(f"{k} is {actual}, not {v}" for k, v, actual in found))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this machine; elsewhere that would be a folder that executors don't see, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise SettingsError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
    return option.get()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table. Columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES, prefix: str = "") -> None:
    """Temporary views of the tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(prefix + name)
