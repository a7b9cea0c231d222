"""Spark session helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC clock (dates and timestamps compare the
# same way as in the SQL oracle), AQE for runtime re-planning and skew splits,
# no web UI.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tidemark") -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` and ``shuffle_partitions`` are only for local runs and tests;
    on a cluster the submitter decides both.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder for materialised tables, models and checkpoints.

    On a cluster this is ``spark.checkpoint.dir`` as set by the submitter (read
    from the session). Only in local mode, where one machine runs everything, may
    it be unset: then a local folder is used, stable across processes so that
    repeated runs reuse tables.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "tidemark-shared")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set the RDD checkpoint folder (Spark adds a unique sub-folder) and return it."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    sc.setCheckpointDir(shared_root(spark))
    return sc._jsc.sc().getCheckpointDir().get()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidemark`` importable in Python workers (pandas UDFs, mapInPandas).

    The package is zipped once per driver process and added with
    ``addPyFile``; Spark distributes it to every executor, so the code runs
    the same on a cluster as in local mode whatever the working directory.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="tidemark-pyfiles-"), "tidemark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def apply_query_settings(spark: SparkSession) -> None:
    """Session settings the queries need regardless of who built the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


#: Spark sends a table to the driver and on to every executor if its files look smaller than this.
#: Files count compressed, so Spark's own 10 MB may be a table of millions of customers.
SMALL_TABLE_BYTES = 1 << 20


def bound_broadcasts(spark: SparkSession) -> None:
    """Only tables that are small whatever the input are broadcast by their size; a table
    of customers is shuffled. Explicit ``broadcast()`` marks stay."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(SMALL_TABLE_BYTES))
