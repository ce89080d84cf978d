"""Spark session set-up and the shared checkpoint folder.

On a cluster the operator of the cluster names a shared folder in
``spark.checkpoint.dir``; every job here reads it from the session.  Only
when it is unset (local tests, the bench) do we pick a scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "feedloom") -> SparkSession:
    """Builder used by tests, tools and the bench (never by library code)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("FEEDLOOM_DRIVER_MEMORY", "16g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def use_store_conventions(spark: SparkSession) -> None:
    """Instants are kept and written in UTC (the store's dates are UTC ISO
    text): set the session time zone for a session that came from elsewhere,
    and make sure the shared checkpoint folder is known."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    It is chosen here only for a local master, where driver and tasks share
    one disk.  Anywhere else an unset ``spark.checkpoint.dir`` is an error:
    a scratch folder would be another folder on every machine.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that every machine shares")
    scratch = tempfile.mkdtemp(prefix="feedloom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    sc.setCheckpointDir(scratch)
    return scratch


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Wide rows (texts, vectors) written once below the shared folder and read
    back: a lineage cut like ``checkpoint()``, but compressed, and a reader
    takes the columns that it needs."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """File system and path of a folder named by URI or by plain path."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)
