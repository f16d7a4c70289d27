"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are stored and compared in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = 8, app: str = "barloom") -> SparkSession:
    """A session for tests and benches; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("BARLOOM_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BARLOOM_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# copies written by this process, per application
_COPIES: dict[str, list[str]] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder: what the caller set last, else ``spark.checkpoint.dir``; a cluster must name one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_copy(spark: SparkSession, label: str) -> str:
    """A place for a copy in the shared folder that ``release`` removes."""
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _COPIES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df, label: str = "table", *partitions: str):
    """Write ``df`` once to the shared folder and read it back.

    For results that several later passes read: lineage is cut, the columns stay
    prunable, and a lost executor only re-reads files. ``release`` removes the
    copies once the results built on them are no longer needed.
    """
    spark = df.sparkSession
    path = fresh_copy(spark, label)
    df.write.parquet(path, partitionBy=list(partitions) or None)
    return spark.read.schema(df.schema).parquet(path)


def copies(spark: SparkSession) -> list[str]:
    """The copies written so far, in order."""
    return list(_COPIES.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Remove copies that nothing will read any more, all by default, and return their number."""
    paths = copies(spark) if paths is None else paths
    gone = set(paths)
    _COPIES[spark.sparkContext.applicationId] = [p for p in copies(spark) if p not in gone]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)
